"""Quality rules: a hashed n-gram log-likelihood ratio of each document, trusted text against the raw corpus.

Words and word pairs are hashed into `buckets`. Two multinomials are fitted: one over the bucket counts of all documents,
one over those of all trusted documents (labels with quality 1 and toxic 0). A document's score is the mean log ratio over
its n-grams. The bar comes from all trusted documents that the base rule passes: they are dealt by hashed id into two
halves, each is scored with the counts of the other half, and the bar is the `keep` quantile of these scores less `slack`;
every document is held to it. Counts and quantile are exact, nothing is drawn or capped; scores are ranked in steps of 2^-40.

Everything is computed in the row with built-in functions. Bucket counts are shuffled, and texts once by doc_id, to meet
their labels; the trusted ones' n-grams are written and read back. A null text is empty and has no
words. Without usable labels every document that passes the base rule is kept. Repeated rows give repeated rows; a null
doc_id is scored like others but never trusted. Other columns are passed through by `keep_good` and not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    smoothing: float = 1.0
    keep: float = 0.002
    slack: float = 0.05


WORD_GAP = r"[\\x20\\x09-\\x0D]+"


def with_words(docs: DataFrame, text: str = "_text") -> DataFrame:
    return docs.withColumn("_words", shared.once(F.expr(rf"filter(split({text}, '{WORD_GAP}', -1), x -> x <> '')")))


def base_columns(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to rows with _text and _words."""
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
            "_lines": shared.once(F.expr(r"filter(split(_text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')")),
            "_windows": shared.once(F.expr("if(size(_words) < 5, array(), transform(sequence(0, size(_words) - 5), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2), get(_words, i + 3), get(_words, i + 4))))")),
        }
    )
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("_sorted", shared.once(F.expr("if(size(array_distinct(_windows)) = size(_windows), array(), sort_array(transform(_windows, (h, i) -> struct(h, i))))"))).drop("_windows")
    df = df.withColumn("_again", shared.once(F.expr("if(size(_sorted) = 0, array(), sort_array(transform(filter(sequence(0, size(_sorted) - 1), k -> coalesce(get(_sorted, k).h = get(_sorted, k - 1).h, false) or coalesce(get(_sorted, k).h = get(_sorted, k + 1).h, false)), k -> get(_sorted, k).i)))"))).drop("_sorted")
    covered = "case when size(_again) = 0 then 0 when size(_again) = 1 then 5 else 5 + aggregate(sequence(0, size(_again) - 2), 0, (a, k) -> a + least(5, get(_again, k + 1) - get(_again, k))) end"
    df = df.withColumn("n_repeat_words", F.expr(covered).cast("long")).drop("_again")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def features(params: Params) -> Column:
    one = f"transform(_words, w -> cast(pmod(xxhash64(w), {params.buckets}) as int))"
    two = f"if(size(_words) < 2, array(), transform(sequence(0, size(_words) - 2), i -> cast(pmod(xxhash64(get(_words, i), get(_words, i + 1)), {params.buckets}) as int)))"
    return F.expr(f"concat({one}, {two})")


def _ratios(raw: dict[int, int], good: dict[int, int], params: Params) -> list[float]:
    from math import log

    a, b = params.smoothing, params.buckets
    of_raw, of_good = (sum(x.values()) + a * b for x in (raw, good))
    return [log((good.get(i, 0) + a) / of_good) - log((raw.get(i, 0) + a) / of_raw) for i in range(b)]


#: Scores are logarithms of ratios of counts, so they are below 64; as steps of 2^-STEP they have 48 bits.
STEP, DIGIT = 40, 16


def _ranked(scores: DataFrame, rank: int) -> float:
    """The score with so many below it, digit by digit: each job counts at most 2^DIGIT cells."""
    steps = scores.select((F.floor(F.col("score") * 2.0**STEP).cast("long") + (1 << 47)).alias("x"))
    found = 0
    for shift in (2 * DIGIT, DIGIT, 0):
        here = steps.where(F.shiftright("x", shift + DIGIT) == found)
        cells = here.groupBy(F.shiftright("x", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")).agg(F.count("*").alias("n"))
        for digit, n in sorted(map(tuple, cells.collect())):
            if rank < n:
                break
            rank -= n
        found = found << DIGIT | digit
    return (found - (1 << 47)) / 2.0**STEP


def quantile(scores: DataFrame, share: float) -> float | None:
    """The exact quantile of column score, between two ranks in proportion; None without rows."""
    n = scores.count()
    if not n:
        return None
    at = share * (n - 1)
    low = _ranked(scores, int(at))
    return low if at == int(at) else low + (at - int(at)) * (_ranked(scores, int(at) + 1) - low)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, _half) of all trusted documents."""
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.withColumn("_half", F.pmod(F.shiftright(F.xxhash64("doc_id"), 8), F.lit(2)))


def fit(docs: DataFrame, labels: DataFrame, params: Params) -> tuple[list[float], float | None]:
    """(log ratio of each bucket, bar). The driver gets `buckets` sums, cells of scores and one number."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("_text"))
    grams = with_words(texts).select(F.explode(shared.once(features(params))).alias("bucket"))
    raw = {r.bucket: r.n for r in grams.groupBy("bucket").agg(F.count("*").alias("n")).toLocalIterator()}
    mine = base_columns(with_words(texts.join(trusted_ids(labels).hint("merge"), "doc_id")))  # one plan for any number of labels
    mine = shared.cut(mine.select("_half", "base_failed", shared.once(features(params)).alias("_grams")), "trusted")
    counts = mine.select("_half", F.explode("_grams").alias("bucket")).groupBy("bucket").agg(*[F.count_if(F.col("_half") == i).alias(f"n{i}") for i in (0, 1)])
    halves = ({}, {})
    for r in counts.toLocalIterator():
        halves[0][r.bucket], halves[1][r.bucket] = r.n0, r.n1
    other = [_mean(_ratios(raw, halves[1 - i], params)) for i in (0, 1)]
    tried = shared.cut(mine.where("not base_failed").select(F.when(F.col("_half") == 0, other[0]).otherwise(other[1]).alias("score")), "scores")
    bar = quantile(tried, params.keep)
    for used in (mine, tried):
        shared.discard(used)
    good = {k: n + halves[1][k] for k, n in halves[0].items()}
    return _ratios(raw, good, params), None if bar is None else bar - params.slack


def _mean(ratios: list[float]) -> Column:
    """The mean ratio over _grams."""
    table = shared.constant(ratios, "double")
    mean = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size("_grams")
    return F.when(F.size("_grams") == 0, 0.0).otherwise(mean)


def scored(worded: DataFrame, ratios: list[float], params: Params) -> DataFrame:
    return worded.withColumn("_grams", shared.once(features(params))).withColumn("score", _mean(ratios)).drop("_grams")


def assess(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with the base columns, score and kept added; a clashing column of docs gives way."""
    ratios, bar = fit(docs, labels, params)
    df = with_words(docs.withColumn("_text", shared.whole_text()))
    df = scored(base_columns(df), ratios, params)
    good = F.lit(True) if bar is None else F.col("score") >= bar
    return df.withColumn("kept", shared.once(~F.col("base_failed") & good)).drop("_words", "_text")


def keep_good(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents that pass, with their own columns."""
    return assess(docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text")), labels, params).where("kept").select("_row.*")
