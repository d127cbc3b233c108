"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Texts are compared without blanks.  Each is cut where its own bytes say so, a
chunk's identifier is its hash once that is verified to name one chunk of the
corpus only, and a document becomes its recipe: the ordered identifiers.  Equal
recipes are then equal texts, so what is grouped and joined are recipes (about
one byte in 200); of the texts, each different chunk moves once, to be verified.

Null and empty texts, and texts of blanks alone, have an empty recipe and are
one group.  Of equal texts the longest original stays, then the smallest
doc_id (a null one last); of rows that are equal in both, one of them, whichever.
Every row has a row of its own in the result, and no other column than doc_id
and text is read.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, hot_keys, table, texts

BLANKS = r"[\x20\x09-\x0D]"
#: Bytes of a chunk: no cut before the first number, one at the second at the latest.
LEAST, MOST = 1024, 16384


def trigger(salt: int) -> str:
    """A class of bytes, about one in eight, chosen by a multiplicative hash."""
    return "[" + "".join(rf"\x{b:02x}" for b in range(256) if (b * 167 + salt) % 256 < 32) + "]"


def chunk_pattern(least: int, most: int) -> str:
    """A chunk ends after the first three bytes that are triggers, between the two lengths; the last one where the text does."""
    return rf"[\x00-\xff]{{{least - 3},{most - 3}}}?{trigger(29)}{trigger(101)}{trigger(211)}|[\x00-\xff]{{1,{most}}}"


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def chunked(norm: Column, least: int, most: int) -> Column:
    """The chunks, each as a string of one character a byte, so that cuts see UTF-8 of any script alike."""
    return F.regexp_extract_all(F.decode(norm.cast("binary"), "ISO-8859-1"), F.lit(chunk_pattern(least, most)), F.lit(0))


def identifier(chunk: Column, width: int, mask: int) -> Column:
    """``width`` hashes of 64 bits, each under a seed of its own."""
    return F.array(*[F.xxhash64(F.lit(i), chunk).bitwiseAND(F.lit(mask)) for i in range(width)])


def verified_width(docs: DataFrame, least: int, most: int, mask: int) -> int:
    """The number of hashes that tell all chunks of the corpus apart.

    Different chunks are found by their bytes; an identifier that two of them
    share calls for one more hash, until none does.
    """
    chunks = docs.select(F.explode(chunked(normal(F.col("text")), least, most)).alias("chunk")).distinct()
    for width in count(1):
        shared = chunks.select(identifier(F.col("chunk"), width, mask).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        if shared.isEmpty():
            return width


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST, mask: int = -1) -> DataFrame:
    """doc_id, n_chars (code points of the original), text_sha256 and recipe of each row; ``mask`` cuts hashes short, for tests."""
    own = texts(docs)
    width = verified_width(own, least, most, mask)
    norm = own.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normal(F.col("text")).alias("norm"))
    recipe = F.flatten(F.transform(chunked(F.col("norm"), least, most), lambda c: identifier(c, width, mask)))
    return norm.select("doc_id", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), recipe.alias("recipe"))


def groups(docs: DataFrame, least: int = LEAST, most: int = MOST, mask: int = -1) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Groups are combined before the shuffle; rows of a large group are dealt to
    several tasks when they meet what is known of it.
    """
    rows = durable(recipes(docs, least, most, mask).withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("recipe")))
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    found = rows.groupBy("key", "recipe").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).where("group_size > 1")
    found = durable(found)
    hot = hot_keys(found, ["key"], F.col("group_size"))
    if hot is None:
        rows, found = rows.withColumn("part", F.lit(0).cast("long")), found.withColumn("part", F.lit(0).cast("long"))
    else:
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        rows = rows.join(hot, "key", "left").withColumn("part", F.pmod("row", parts)).drop("parts")
        found = found.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    out = rows.join(found, ["key", "part", "recipe"], "left")
    alone = F.col("best").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay."""
    made = ["__sha256", "__n_chars", "__id"]
    key = F.struct(*made)
    of = durable(groups(docs)).groupBy(F.struct(F.col("text_sha256").alias(made[0]), F.col("n_chars").alias(made[1]), F.col("doc_id").alias(made[2])).alias("__key")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n")).where("__kept")
    text = F.col("text").cast("string")
    marked = docs.withColumn(made[0], F.sha2(normal(text).cast("binary"), 256)).withColumn(made[1], F.char_length(F.coalesce(text, F.lit(""))).cast("long")).withColumn(made[2], F.col("doc_id").cast("long")).withColumn("__key", key)
    best = marked.join(of, "__key")
    return best.where("__n = 1").select(*docs.columns).unionAll(best.where("__n > 1").dropDuplicates(["__key"]).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("n_chars")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (
  SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""
