"""Secrets, told from examples by how many owners use the same value.

A scan finds candidates; their hashes are counted over the corpus by distinct
documents and distinct sources.  A value that several sources share, or very
many documents of whatever source, is a copied example; one that stays with its owner and looks random is live.
Candidates of the looser kinds are reported only where they come out as live.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, durable, hot_keys, split_join, table, texts

KINDS = ("assign", "access", "hex", "key", "jwt", "opaque")
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 24),
}
MORE = {
    "key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    "opaque": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}(?![A-Za-z0-9+/_=-])"),
}
#: What follows a private key's first line: its body, which tells one key from another.
BODY = re.compile(r"[A-Za-z0-9+/=\s]*+")
#: A value that so many sources, or so many documents, hold is an example.
SHARED_OWNERS, SHARED_DOCS = 3, 100
#: Bits a character, and characters, that a live secret has at least.
LIVE_BITS, LIVE_LENGTH = 3.0, 16


def bits(value: str) -> float:
    n = len(value)
    return -math.fsum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    return len(value) >= LIVE_LENGTH and bits(value) >= LIVE_BITS and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of every candidate, in order; the base kinds come first in KINDS."""
    out = []
    for k, (kind, (pattern, least)) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            value = m.group(2) if kind == "assign" else m.group()
            if len(value) >= least:
                out.append((m.start(), m.end(), k, value))
    base = sorted(out)
    ends = list(itertools.accumulate((e for _, e, _, _ in base), max))  # the furthest end so far
    for kind, pattern in MORE.items():
        for m in pattern.finditer(text):
            value = m.group()
            if kind == "opaque":
                i = bisect.bisect_left(base, (m.end(),))
                if not looks_random(value) or (i and ends[i - 1] > m.start()):
                    continue
            if kind == "key":
                value += "".join(BODY.match(text, m.end()).group().split())
            out.append((m.start(), m.end(), KINDS.index(kind), value))
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32()), ("h", pa.int64()), ("r", pa.bool_())]))
        for batch in batches:
            found = [
                [{"s": s, "e": e, "k": k, "h": xxhash.xxh64_intdigest(v) - (1 << 63), "r": k == 3 or looks_random(v)} for s, e, k, v in find(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(found, kind_of)], names=["doc_id", "source", "found"])

    return arrow_map(texts(docs, F.col("source").cast("string").alias("source")), kernel, "doc_id long, source string, found array<struct<s: long, e: long, k: int, h: long, r: boolean>>")


def secrets(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, all spans, and verdicts, for every row.

    n_live, n_example and n_weak count candidate spans by verdict: shared by
    SHARED_OWNERS sources or SHARED_DOCS documents or more (example), else
    random-looking (live), else weak.  Null text has none; a null source is an
    owner of its own kind; a null doc_id is no document in the counts; rows
    that repeat a doc_id get a row each and count as one document.
    """
    rows = durable(scan(docs).withColumn("row", F.monotonically_increasing_id()))
    each = rows.where(F.size("found") > 0).select("row", "doc_id", F.concat(F.lit("="), "source").alias("source"), F.explode("found.h").alias("h"))
    per_doc = each.select("h", "source", "doc_id").distinct()  # a row for each value, owner and document, however often it stands there
    owners = F.count_distinct("source") + F.max(F.col("source").isNull().cast("int"))
    held = per_doc.groupBy("h").agg(owners.alias("owners"), F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("c"))
    shared = durable(held.where((F.col("owners") >= SHARED_OWNERS) | (F.col("n_docs") >= SHARED_DOCS)).select("h", "c"))
    met = split_join(each.select("row", "h").distinct(), shared.select("h"), ["h"], "row", hot_keys(shared, ["h"], F.col("c")))  # a value of very many documents is met in parts
    told = rows.join(met.groupBy("row").agg(F.collect_list("h").alias("examples")), "row", "left").select("doc_id", "found", "examples")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "n_weak"]
        for batch in batches:
            out = []
            for found, known in zip(batch.column("found").to_pylist(), batch.column("examples").to_pylist(), strict=True):
                known, n, verdicts, base, spans = set(known or ()), [0, 0, 0], [0, 0, 0], [], []
                for x in found or ():
                    verdict = 1 if x["h"] in known else 0 if x["r"] else 2
                    verdicts[verdict] += 1
                    said = f"{KINDS[x['k']]}:{x['s']}:{x['e']}"
                    if x["k"] < 3:
                        n[x["k"]] += 1
                        base.append(said)
                    if x["k"] < 3 or verdict == 0:
                        spans.append(said)
                out.append((*n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans), *verdicts))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(cols))], names=names)

    return arrow_map(told, kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_example long, n_weak long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
