"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose defect share exceeds a cutoff.  The shares
are fixed in advance, so every labelled document is a holdout row: per stratum
(language) and rule, cutoffs are tested from the mildest down, and a cutoff is
certified while an exact binomial test (the Clopper-Pearson bound) shows that
it rejects at most ``alpha / rules`` of the good documents.  The tests of one
chain are a fixed sequence; chains share ``delta`` by Bonferroni.  Among the
certified cutoffs the one with the largest net benefit is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, durable, table, texts, utf8, with_ids

#: A stratum's good documents may be rejected at this rate in all, with this probability of error in all.
ALPHA, DELTA = 0.05, 0.05
#: Shares are compared in thousandths.
BINS = 1000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A good document lost weighs as much as this many bad ones found.
GOOD_WEIGHT = 3.0

FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "shout_share": ("n_shout", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shout")
SPACE, SYMBOLS, UPPER, SHOUT = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?"
FOLLOWING = bytes(range(0x80, 0xC0))


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        code = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        code = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(ids), bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        again[at + k] = True
    return int(again.sum())


def counts(text: bytes, known: dict[bytes, int]) -> tuple[int, ...]:
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, FOLLOWING)))
    removed = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return len(words), points - removed(SPACE), removed(SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids), len(lines), removed(UPPER), removed(SHOUT)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """One row of counts per row of ``docs``; the text itself stays behind."""
    own = texts(docs, *keep)
    schema = T.StructType([own.schema["doc_id"], *(own.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            found = np.array([counts(x, known) for x in utf8(batch, "text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in keep), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *keep, *COUNTS])

    return arrow_map(own, kernel, schema)


def share(over: str, of: str):
    """Thousandths, rounded down; 0 where there is nothing to share."""
    return F.when(F.col(of) > 0, F.least(F.lit(BINS), F.floor(F.col(over) * BINS / F.col(of)))).otherwise(F.lit(0)).cast("int")


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1, dtype=np.float64)
    step = np.concatenate([[0.0], np.log((n - i[:-1]) / (i[:-1] + 1)) + math.log(p / (1 - p))])
    terms = n * math.log1p(-p) + np.cumsum(step)
    top = terms.max()
    return float(min(0.0, top + math.log(np.exp(terms - top).sum())))


def certify(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int:
    """The best certified cutoff: reject shares above it (BINS: reject none).

    good, bad: labelled documents by share.  Walks down until a test fails.
    """
    n, best, gain = int(good.sum()), BINS, 0.0
    lost, found = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    for cut in range(BINS - 1, -1, -1):
        if n == 0 or log_binomial_cdf(int(lost[cut + 1]), n, alpha) > math.log(delta):
            break
        if (now := float(found[cut + 1]) - GOOD_WEIGHT * float(lost[cut + 1])) > gain:
            best, gain = cut, now
    return best


def thresholds(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """(stratum, feature) -> cutoff, from all labelled documents.

    Only a histogram leaves the executors: a row per stratum, feature, share
    and label at most.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"))
    marked = durable(marked)
    held = measure(with_ids(own, marked.select("doc_id")), "stratum")  # only labelled texts are measured
    long = held.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words").join(marked, "doc_id").select("stratum", "quality", F.posexplode(F.array(*(share(*x) for x in FEATURES.values()))).alias("feature", "bin"))
    names, by = list(FEATURES), {}
    for r in long.groupBy("stratum", "feature", "bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).toLocalIterator():
        h = by.setdefault((r.stratum, names[r.feature]), np.zeros((2, BINS + 2), np.int64))
        h[:, r.bin] += (r.good, r.bad)
    return {k: certify(h[0], h[1], alpha / len(FEATURES), delta / len(by)) for k, h in by.items()}


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and a verdict for every row of ``docs``, and the columns to ``keep``.

    Null text has no words and fails; a stratum without labels keeps all that
    pass the base rules; a null language is the stratum "und"; repeated rows
    get a row each; of several labels of a document the lowest counts.
    """
    cuts = thresholds(docs, labels, alpha, delta)
    rows = measure(docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"), *keep), "stratum", *keep)
    rejected = F.lit(False)
    for feature, parts in FEATURES.items():
        cut = F.lit(BINS)
        for (stratum, name), value in sorted(cuts.items()):
            if name == feature and value < BINS:
                cut = F.when(F.col("stratum") == stratum, F.lit(value)).otherwise(cut)
        rejected = rejected | (share(*parts) > cut)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, with the columns they came with.

    A row is judged by its own text: one without a doc_id as well, and of rows
    that share a doc_id each for itself.  Rows go through the counting whole, so
    nothing is joined.
    """
    rows = docs.select("doc_id", "text", "lang", F.struct("*").alias("row"))
    return judge(rows, table(spark, sf_dir, "labels"), keep=("row",)).where("kept").select("row.*")
