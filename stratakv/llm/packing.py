"""Documents into sequences of at most `capacity` tokens by sum-of-squares online packing.

Each input partition packs its own documents, in one pass. N(l) counts the open sequences of fill level l, a level being
`grain` tokens wide. Full windows of a long document leave at once; what is left goes to the level (to its emptiest
sequence) or to a new sequence for which the sum of all N(l)^2 becomes smallest, the fuller level on ties. A sequence with
less than `grain` tokens of room is no longer open: the documents that come next fill it, and it leaves. A document may
also be cut, to fill the fullest sequence of a level and go on in a new one, where that makes the sum smaller by more than
`cut_cost`: so no level grows beyond about half of that, whatever the lengths, and memory is bounded. At the end of a
partition the fullest open sequences are filled from the emptiest ones, and the rest is cut into sequences whose lengths
are powers of two, so nothing is padded.

A null text is empty: its end token alone. Repeated rows are packed each. Very long texts are cut into windows. An empty
table gives no rows. Other columns are not looked at. A partition that is computed again gives the same rows: nothing
depends on time or chance.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, shared


@dataclass(frozen=True)
class Params:
    tokenizer: str
    capacity: int = 4096
    end_id: int = 2
    grain: int = 128
    cut_cost: int = 32
    fold: bool = True


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


class Packer:
    def __init__(self, params: Params, first_sequence: int):
        self.p, self.sequence, self.rows = params, first_sequence, []
        self.level = np.zeros(params.capacity // params.grain + 1, np.int64)
        self.open: list[list[tuple[int, int, list[Piece]]]] = [[] for _ in self.level]  # heaps by fill, then age
        self.filling: list[tuple[int, list[Piece]]] = []
        self.age = 0
        self.placed = 0  # sequences that placement closed

    def add(self, doc, ids: np.ndarray) -> None:
        at, n, c = 0, len(ids), self.p.capacity
        while n - at >= c:
            self._emit([Piece(doc, at, ids[at : at + c], n)])
            self.placed += 1
            at += c
        while at < n and self.filling:
            fill, pieces = self.filling.pop()
            piece = Piece(doc, at, ids[at : at + c - fill].copy(), n)
            at += len(piece.ids)
            self._put(fill + len(piece.ids), [*pieces, piece])
        if at < n:
            self._place(doc, at, ids, n)

    def _place(self, doc, at: int, ids: np.ndarray, n: int) -> None:
        level, cut = self._choose(n - at)
        if cut:
            fill, _, pieces = max(self.open[level])
            self.open[level].remove((fill, _, pieces))
            heapq.heapify(self.open[level])
            end = at + self.p.capacity - fill
            self.level[level] -= 1
            self._put(self.p.capacity, [*pieces, Piece(doc, at, ids[at:end].copy(), n)])
            at, level = end, -1
        fill, pieces = 0, []
        if level >= 0:
            fill, _, pieces = heapq.heappop(self.open[level])
            self.level[level] -= 1
        self._put(fill + n - at, [*pieces, Piece(doc, at, ids[at:].copy(), n)])

    def _put(self, fill: int, pieces: list[Piece]) -> None:
        if fill == self.p.capacity:
            self._emit(pieces)
            self.placed += 1
        elif fill > self.p.capacity - self.p.grain:
            self.filling.append((fill, pieces))
        else:
            self.level[fill // self.p.grain] += 1
            heapq.heappush(self.open[fill // self.p.grain], (fill, self.age, pieces))
            self.age += 1

    def _choose(self, r: int) -> tuple[int, bool]:
        """The level to take r tokens (-1: a new sequence), and whether they are cut there.

        A sequence that moves from l to m changes the sum by 2 (N(m) - N(l) + 1); one that begins at m by 2 N(m) + 1, one
        that leaves l by 1 - 2 N(l).
        """
        c, g, count = self.p.capacity, self.p.grain, self.level
        begun = lambda fill: 0 if fill > c - g else 2 * int(count[fill // g]) + 1
        best = (begun(r), 1, -1, False)
        for level in np.flatnonzero(count).tolist():
            gone = 1 - 2 * int(count[level])
            fill = self.open[level][0][0] + r
            if fill <= c:
                change = 0 if fill // g == level and fill <= c - g else gone + begun(fill)
                best = min(best, (change, -level, level, False))
            most = max(self.open[level])[0]
            if most + r > c:
                best = min(best, (gone + begun(most + r - c) + self.p.cut_cost, -level, level, True))
        return best[2], best[3]

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, self.sequence, offset))
            offset += len(p.ids)
        self.sequence += 1

    def finish(self) -> None:
        """Fill the fullest open sequences from the emptiest; cut what is left into powers of two from the largest."""
        c = self.p.capacity
        placed = [pieces for heap in self.open for _, _, pieces in sorted(heap)] + [pieces for _, pieces in sorted(self.filling)]
        left = sum(len(p.ids) for pieces in placed for p in pieces)
        rest: list[Piece] = []
        first = 0
        while left:
            want = c if left >= c else 1 << (left.bit_length() - 1)
            left -= want
            pieces = placed.pop() if want == c and first < len(placed) else []
            want -= sum(len(p.ids) for p in pieces)
            while want:
                if not rest:
                    rest = placed[first][::-1]
                    first += 1
                p = rest.pop()
                if len(p.ids) > want:
                    rest.append(Piece(p.doc, p.start + want, p.ids[want:], p.doc_tokens))
                    p = Piece(p.doc, p.start, p.ids[:want], p.doc_tokens)
                want -= len(p.ids)
                pieces.append(p)
            self._emit(pieces)

    def taken(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if not rows:
            return None
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, params: Params) -> DataFrame:
    """A row for each piece of a document."""
    shared.ship(docs.sparkSession)

    def run(batches):
        context = TaskContext.get()
        packer = Packer(params, (context.partitionId() if context else 0) << 32)
        encoder = bpe.encoder(params.tokenizer, params.fold)
        end = np.array([params.end_id], np.uint32)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, ids, bounds in encoder.encode(batch.column("text")):
                for i in range(len(bounds) - 1):
                    packer.add(names[a + i], np.concatenate([ids[bounds[i] : bounds[i + 1]], end]))
            if (rows := packer.taken()) is not None:
                yield rows
        packer.finish()
        if (rows := packer.taken()) is not None:
            yield rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    return rows.mapInArrow(run, SCHEMA)
