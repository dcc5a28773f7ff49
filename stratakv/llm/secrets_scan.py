"""Secrets in texts: fixed patterns, and values in credential contexts that would be costly to guess.

The guess cost of a value is the smallest cost of cutting it into words, dates, repeats, runs along the keyboard or the
alphabet, and brute-force stretches; a dynamic program finds it, in log10 of guesses. A value named by a credential word
is reported when its cost reaches `min_cost`: a random key does, a placeholder or a dictionary word does not.

Base patterns (assign, access, hex) are always reported. Arrow's regular expressions first tell which texts can hold any
match at all; only those are searched. A null text is empty. Repeated rows give repeated rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from math import log10

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BEARER = r"A-Za-z0-9+/_.=~-"
LOGIN = r"://[^\s/:@]+:"
NAMED = r"(?:pwd|passphrase|private_?key|access_?key|client_?secret|credentials?|auth_?key|signing_?key)[\"']?\x20*[:=]"
#: Contexts of the method beside the base ones: kind, how to tell that a text may hold one, expression; the value is group 1.
#: Both are made of the same parts, so no text that an expression matches is passed over.
CONTEXTS = (
    ("bearer", rf"(?i)bearer\x20+[{BEARER}]", re.compile(rf"\bbearer\x20+([{BEARER}]{{16,}})", re.I | re.A)),
    ("login", rf"{LOGIN}[^\s/@]+@", re.compile(rf"{LOGIN}([^\s/@]{{4,}})@")),
    ("named", rf"(?i){NAMED}", re.compile(rf"{NAMED}\x20*[\"']?([^\s\"',;]{{6,}})", re.I | re.A)),
)
GATE_BASE = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}",
    r"AKIA[A-Z0-9]{16}",
    r"[0-9a-f]{24}",
)
KINDS = ("assign", "access", "hex", "guess")

#: Words that people use in passwords and placeholders, commonest first.
COMMON = (
    "password pass admin user login secret token test example sample demo changeme change me default qwerty letmein welcome "
    "master root guest hello monkey dragon football baseball superman batman shadow sunshine princess iloveyou love god money "
    "freedom trustno whatever star wars computer internet server database oracle mysql postgres key api my your the this is "
    "a an and not none null true false dummy fake placeholder insert here value string redacted hidden xxxx foo bar baz temp "
    "dev prod staging local company office summer winter spring autumn january february march april may june july august "
    "september october november december monday friday red blue green black white"
).split()
#: Keyboard and alphabet lines along which people walk.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON))}
LONGEST = max(map(len, RANK))
UNLEET = str.maketrans("@4310$57!", "aaeiosst" + "i")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")


@dataclass(frozen=True)
class Params:
    min_cost: float = 9.0
    min_length: int = 6


def _steps() -> dict[str, str]:
    """For each two characters that stand side by side on a walk, its direction."""
    return {x + y: d for line in WALKS for d, run in (("+", line), ("-", line[::-1])) for x, y in zip(run, run[1:], strict=False)}


STEPS = _steps()


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation of value."""
    n = len(value)
    low = value.lower() if value.isascii() else value
    plain = low.translate(UNLEET)
    best = [0.0] + [float("inf")] * n
    repeat = walk = 0  # where the runs that reach the current place begin
    walk_direction = None
    dates = {}
    for m in DATE.finditer(value):
        dates.setdefault(m.end(), []).append(m.start())
    for end in range(1, n + 1):
        c = value[end - 1]
        # a brute-force character: its alphabet's size
        alphabet = 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000
        cost = best[end - 1] + log10(alphabet)
        for length in range(2, min(LONGEST, end) + 1):
            start = end - length
            w = low[start:end]
            rank = RANK.get(w)
            extra = 0.0
            if rank is None:
                rank, extra = RANK.get(plain[start:end]), log10(2 * length)
            if rank:
                if value[start:end] != w:
                    extra += log10(2 if value[start:end].istitle() or value[start:end].isupper() else 2 * length)
                cost = min(cost, best[start] + log10(rank + 1) + extra)
        if end > 1 and c != value[end - 2]:
            repeat = end - 1
        if end - repeat > 2:
            cost = min(cost, best[repeat] + log10(alphabet * (end - repeat)))
        d = STEPS.get(low[end - 2 : end]) if end > 1 else None
        if d is None or d != walk_direction and walk_direction is not None:
            walk = end - 2 if d else end - 1
        walk_direction = d
        if d and end - walk > 2:
            cost = min(cost, best[walk] + log10(2 * 47 * (end - walk)))
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + log10(365 * 100))
        best[end] = cost
    return best[n]


def scan_text(text: str, base: tuple[bool, bool, bool], contexts: tuple[bool, ...], params: Params) -> tuple[list, list]:
    """(base spans, spans of the method) as (start, order of kind, end)."""
    found, values = [], []
    if base[0]:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end()))
                values.append((m.start(2), m.end(2)))
    if base[1]:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if base[2]:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    for on, (_, _, pattern) in zip(contexts, CONTEXTS, strict=True):
        if on:
            values += [m.span(1) for m in pattern.finditer(text)]
    costly = [(s, 3, e) for s, e in dict.fromkeys(values) if e - s >= params.min_length and guess_cost(text[s:e]) >= params.min_cost]
    return sorted(found), sorted(costly)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """A row for each row of docs: counts of base matches, digest of base spans, all spans."""
    shared.ship(docs.sparkSession)

    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            gates = [pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in (*GATE_BASE, *(g for _, g, _ in CONTEXTS))]
            n = batch.num_rows
            counts = [[0] * n for _ in range(3)]
            digest, spans = [empty] * n, [""] * n
            for i in sum(g.astype(int) for g in gates).nonzero()[0].tolist():
                base, more = scan_text(texts[i].as_py(), tuple(g[i] for g in gates[:3]), tuple(g[i] for g in gates[3:]), params)
                for _, k, _ in base:
                    counts[k][i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(sorted([*base, *more]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
