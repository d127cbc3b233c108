"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent: 1 keeps them, 0 levels them.
The exponent is found by bisection, as close to level as the limit on
repetitions allows (or where the mix reaches a target entropy).  The weights
become whole passes over a source and a part of one more: a source's documents
lie in hashed blocks, the blocks in a seeded order, and the last pass takes
blocks until its budget is met, cutting only the block that crosses it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, durable, table, texts, utf8

#: Passes over one source at most.
MAX_REPEATS = 1.25
#: Blocks of a source, twice as many again while they would hold more rows on average; sums over blocks are what orders documents, so no task sees a source whole.
BLOCKS, BLOCK_ROWS = 1024, 10_000
SEED = 20240501


def tempered(tokens: dict, exponent: float, times: dict | None = None) -> dict:
    """Weights proportional to share ** exponent; a source without tokens has none.  An entry stands for as many sources as ``times`` says, one by default."""
    of = lambda s: times[s] if times else 1
    total = sum(n * of(s) for s, n in tokens.items())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()} if total else dict.fromkeys(tokens, 0.0)
    norm = math.fsum(w * of(s) for s, w in raw.items())
    return {s: w / norm if norm else 0.0 for s, w in raw.items()}


def entropy(weights: dict, times: dict | None = None) -> float:
    return -math.fsum(w * math.log(w) * (times[s] if times else 1) for s, w in weights.items() if w > 0)


def repeats(tokens: dict[str, int], weights: dict[str, float], budget: float) -> float:
    return max((weights[s] * budget / n for s, n in tokens.items() if n), default=0.0)


def exponent_for(tokens: dict, budget: float, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, times: dict | None = None) -> float:
    """The least exponent in [0, 1] whose mix keeps the limit; with a target, the largest one that reaches that entropy as well if the limit lets it.

    Repetitions fall and entropy falls as the exponent grows, so bisection
    finds both.  At 1 each source is passed over budget / tokens times.
    """
    lo, hi = 0.0, 1.0
    most = lambda x: repeats(tokens, tempered(tokens, x, times), budget)
    spread = lambda x: entropy(tempered(tokens, x, times), times)
    if most(0.0) <= max_repeats:
        least = 0.0
    else:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if most(mid) <= max_repeats else (mid, hi)
        least = hi
    if target_entropy is None:
        return least
    if spread(1.0) >= target_entropy:
        return 1.0
    lo, hi = least, 1.0
    if spread(least) < target_entropy:
        return least
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spread(mid) >= target_entropy else (lo, mid)
    return lo


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and n_tokens of every row; words stand for tokens."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([len(x.split()) for x in utf8(batch, "text")], pa.int64())], names=["doc_id", "source", "n_tokens"])

    return arrow_map(texts(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")), kernel, "doc_id long, source string, n_tokens long")


def in_block(seed: int, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "source", F.lit(seed)), F.lit(n_blocks)).cast("int")


def layout(sizes: DataFrame, max_repeats: float, target_entropy: float | None, budget: int | None, seed: int) -> tuple[DataFrame, int]:
    """Blocks of each source in their order (source, block, in_block, before, place, weight, passes, part), and the number of blocks.

    sizes: doc_id, source, n_tokens.  The driver gets the different token
    totals of sources with their numbers: of T tokens sqrt(2 T) at most.
    """
    n_blocks = BLOCKS
    while n_blocks * BLOCK_ROWS < sizes.count():
        n_blocks *= 2
    blocks = durable(sizes.groupBy("source", in_block(seed, n_blocks).alias("block")).agg(F.sum("n_tokens").alias("in_block")))
    totals = durable(blocks.groupBy("source").agg(F.sum("in_block").alias("tokens")))
    times = {int(r.tokens or 0): r.sources for r in totals.groupBy("tokens").agg(F.count("*").alias("sources")).toLocalIterator()}
    tokens = {n: n for n in times}
    goal = sum(n * k for n, k in times.items()) if budget is None else budget
    weights = tempered(tokens, exponent_for(tokens, goal, max_repeats, target_entropy, times), times)
    each = [(n, weights[n]) for n in sorted(weights)]
    weighed = totals.join(totals.sparkSession.createDataFrame(each, "tokens long, weight double"), "tokens")
    aim = F.col("weight") * F.lit(float(goal))
    passes = F.when(F.col("tokens") > 0, F.floor(aim / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    sources = weighed.select("source", "weight", passes.alias("passes"), F.when(F.col("tokens") > 0, F.floor(aim - passes * F.col("tokens"))).otherwise(F.lit(0)).cast("long").alias("part"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", "source", F.lit(seed + 1)), "block")
    # as many rows of a source as there are blocks
    placed = blocks.withColumn("place", F.row_number().over(order)).withColumn("before", F.sum("in_block").over(order) - F.col("in_block")).join(sources, "source")
    return durable(placed), n_blocks


def with_copies(rows: DataFrame, placed: DataFrame, seed: int, columns: list[str]) -> DataFrame:
    """``rows`` (doc_id, source, block, n_tokens, columns) with their block's place, weight and copies; only the rows of a source's cut block are put in order."""
    rows = rows.join(placed, ["source", "block"])
    whole = rows.where("before + in_block <= part or before >= part").withColumn("extra", (F.col("before") < F.col("part")).cast("long"))
    within = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where("before < part and before + in_block > part").withColumn("extra", (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)) < F.col("part")).cast("long"))
    return whole.unionByName(cut).select(*columns, "weight", (F.col("passes") + F.col("extra")).alias("copies"), "block", "place")


def mix_plan(docs: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """How often each document is used, for every row of ``docs``.

    doc_id, source, n_tokens, weight (of its source), copies, block and place
    (of its block in the source's order).  Copies are the whole passes over the
    source, and one more for documents that begin within the part pass.  The
    budget is the corpus's own tokens unless given.  A null source is the
    source ""; a document without words costs nothing and follows its block;
    rows that repeat a doc_id are placed next to each other, each with its own
    copies; an empty table gives no rows.
    """
    sizes = durable(sized(docs))
    placed, n_blocks = layout(sizes, max_repeats, target_entropy, budget, seed)
    return with_copies(sizes.withColumn("block", in_block(seed, n_blocks)), placed, seed, ["doc_id", "source", "n_tokens"])


def mixed(docs: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan uses it.

    All columns of ``docs`` and one, ``mix``: weight, copy (1, 2, ...), block
    and place; where ``docs`` has a column of that name, it is ``mix_``, and so
    on.  Sorted by copy, place and block, a source's rows are in the
    order in which they are read.  Texts meet the blocks, which are few, and
    only those of a source's cut block are shuffled.
    """
    sizes = durable(sized(docs))
    placed, n_blocks = layout(sizes, max_repeats, target_entropy, budget, seed)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")).cast("long")
    rows = rows.select("row", "doc_id", "source", words.alias("n_tokens"), in_block(seed, n_blocks).alias("block"))
    used = with_copies(rows, placed, seed, ["row"]).where("copies > 0")
    each = used.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    name = "mix"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return each.select("row.*", F.struct("weight", "copy", "block", "place").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, texts included, each as often as it is read."""
    return mixed(docs)
