"""Sinks: tables, vectors per stem, and a provenance manifest."""

from __future__ import annotations

import os
import socket

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_vectors(df: DataFrame, path: str, places: int = 9) -> None:
    """A folder for each stem with one time a line, in order; df: (stem, beats)."""
    lines = df.select("stem", F.array_join(F.transform(F.array_sort("beats"), lambda t: F.format_string(f"%.{places}f", t)), "\n").alias("value"))
    lines.write.mode("overwrite").partitionBy("stem").text(path)


def commit_of(folder: str) -> str | None:
    """The commit that a git folder stands at, read from its files; None where there is none."""
    head = os.path.join(folder, ".git", "HEAD")
    if not os.path.isfile(head):
        return None
    with open(head) as f:
        text = f.read().strip()
    if not text.startswith("ref: "):
        return text
    name = text[5:]
    loose, packed = os.path.join(folder, ".git", name), os.path.join(folder, ".git", "packed-refs")
    if os.path.isfile(loose):
        with open(loose) as f:
            return f.read().strip()
    if os.path.isfile(packed):
        with open(packed) as f:
            return next((line.split()[0] for line in f if line.rstrip().endswith(" " + name)), None)
    return None


def provenance(inputs: DataFrame, outputs: DataFrame, config_sha256: str, commit: str | None = None, host: str | None = None) -> DataFrame:
    """A row for each file with its role and digest, and the run's host and commit; both tables as ``readers.files`` gives them."""
    role = lambda d, r: d.select(F.lit(r).alias("role"), "path", "length", "sha256")
    return role(inputs, "input").unionAll(role(outputs, "output")).withColumns({"config_sha256": F.lit(config_sha256), "host": F.lit(host or socket.gethostname()), "commit": F.lit(commit).cast("string"), "written_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")})


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A small table as Markdown; a larger one is an error, as a report is read by people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    text = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *(line([text(v) for v in r]) for r in rows), ""])


def run_summary(manifests: DataFrame) -> DataFrame:
    """One row for a run of several stages' manifests: files and bytes by role, and one digest over theirs in order of path."""
    files = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return manifests.groupBy("role").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.transform(files, lambda x: x["sha256"]), ","), 256).alias("sha256"))
