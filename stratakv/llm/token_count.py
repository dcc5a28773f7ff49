"""Token counts with the whole-token shortcut.

Before any text is read, every vocabulary string is encoded alone; those that come back as one token, their own, are
proven. A segment of a text (see bpe) that is a proven string counts as one token without any merging; the others are
merged by the library, once for each distinct one a worker meets. The proven strings are at most the vocabulary.

A null text counts as empty (no tokens). Repeated rows give repeated rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, shared, words


@dataclass(frozen=True)
class Params:
    tokenizer: str
    limit: int = 512


def proven(path: str) -> list[tuple[str, int]]:
    """The vocabulary's strings that encode alone as one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    byte = {c: b for b, c in bpe.LETTERS.items()}
    strings = []
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            strings.append((bytes(byte[c] for c in token).decode(), number))
        except (UnicodeDecodeError, KeyError):
            continue  # part of a character: no text is this token alone
    alone = tokenizer.encode_batch([s for s, _ in strings], add_special_tokens=False)
    return [(s, n) for (s, n), e in zip(strings, alone, strict=True) if e.ids == [n]]


@lru_cache(maxsize=2)
def _counter(path: str, table) -> bpe.Encoder:
    out = bpe.Encoder(path, fold=False)
    strings, numbers = zip(*table.value, strict=True)
    out.learn(np.array([words.hash_one(s.encode()) for s in strings], np.uint64), [[n] for n in numbers])
    return out


def token_counts(docs: DataFrame, params: Params) -> DataFrame:
    spark = docs.sparkSession
    shared.ship(spark)
    table = spark.sparkContext.broadcast(proven(params.tokenizer))

    def run(batches):
        counter = _counter(params.tokenizer, table)
        for batch in batches:
            _, offsets = words.buffers(batch.column("text"))
            n = counter.count(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > params.limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
