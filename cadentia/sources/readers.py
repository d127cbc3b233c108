"""Sources: trial exports, beat files, annotator files, manifests, vector files.

All go through Spark's readers, so any file system that Spark knows will do;
paths may be globs.  Schemas are stated, never inferred.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLANKS = r"[\s,]+"


def csv_columns(spark: SparkSession, path: str, wanted: Sequence[str], where: str | None = None, parts: int | None = None, by: str | None = None) -> DataFrame:
    """The wanted columns that the files have, as text; absent ones are left out.

    ``where`` is a condition on any of the files' columns, applied as rows are
    read, so of a file of any size only what it lets pass is kept.  A gzip file
    is read by one task; ``parts`` deals its rows to so many, by the column
    ``by`` if there is one.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = (df.where(where) if where else df).select(*(c for c in wanted if c in df.columns))
    return df if parts is None else df.repartition(parts, by) if by else df.repartition(parts)


def merged_exports(spark: SparkSession, paths: Sequence[str], wanted: Sequence[str], level: int = 1) -> DataFrame:
    """Several exports in one table: the label is a parent folder, and prefixes the participant."""
    out = None
    for path in paths:
        df = csv_columns(spark, path, wanted)
        label = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - level)
        df = df.withColumn("_source_batch", label)
        if "participant_id" in df.columns:
            df = df.withColumn("participant_id", F.concat_ws(":p", "_source_batch", "participant_id"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def beat_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, t, pos) from lines of time and position; malformed lines are left out, a missing position is -1."""
    lines = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1).alias("stem"), F.split(F.trim("value"), r"\s+").alias("x"))
    t, pos = F.get("x", F.lit(0)).try_cast("double"), F.coalesce(F.get("x", F.lit(1)).try_cast("double").cast("int"), F.lit(-1))
    return lines.select("stem", t.alias("t"), pos.alias("pos")).where("t is not null and not isnan(t)")


def annotator_files(spark: SparkSession, path: str, start: float, stop: float, least: int = 3) -> DataFrame:
    """(stem, annotator, times): a line for each annotator, times in the window, to the millisecond, distinct, ``least`` at least."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1).alias("stem"), F.posexplode(F.split("value", "\n")).alias("annotator", "line"))
    numbers = F.transform(F.split(F.trim("line"), BLANKS), lambda x: F.rint(x.try_cast("double") * 1000) / 1000)
    times = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & x.between(start, stop))))
    return files.select("stem", "annotator", times.alias("times")).where(F.size("times") >= least)


def first_columns(spark: SparkSession, path: str) -> DataFrame:
    """(stem, times): the first column of beat files, sorted."""
    b = beat_files(spark, path)
    return b.groupBy("stem").agg(F.array_sort(F.collect_list("t")).alias("times"))


def annotator_line(spark: SparkSession, path: str, start: float, stop: float, index: int) -> DataFrame:
    """(stem, times): one annotator's line, by its place in the file, in the window and sorted; not rounded."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1).alias("stem"), F.get(F.split("value", "\n"), F.lit(index)).alias("line"))
    numbers = F.transform(F.split(F.trim("line"), BLANKS), lambda x: x.try_cast("double"))
    return files.select("stem", F.array_sort(F.filter(numbers, lambda x: x.isNotNull() & x.between(start, stop))).alias("times")).where("line is not null")


def annotators_pooled(spark: SparkSession, path: str, start: float, stop: float) -> DataFrame:
    """(stem, times): all annotators' times in the window, sorted together, repeats included."""
    numbers = F.transform(F.split(F.trim("value"), BLANKS), lambda x: x.try_cast("double"))
    lines = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1).alias("stem"), F.explode(numbers).alias("t"))
    return lines.where(F.col("t").between(start, stop)).groupBy("stem").agg(F.array_sort(F.collect_list("t")).alias("times"))


def stem_of(name: str) -> str:
    return re.sub(r"(_crowd_gs)?\.[^.]*$", "", name)


def empty_files(spark: SparkSession, pattern: str) -> list[str]:
    """Names of files without a byte, which Spark's scans pass over; a listing of the folder on the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return [f.getPath().getName() for f in found if f.isFile() and f.getLen() == 0]


def vector_files(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """(stem, values): a number a line; where a stem matches several patterns the first one counts."""
    out = None
    for rank, pattern in enumerate(patterns):
        v = spark.read.text(pattern).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:_crowd_gs)?\.[^.]*$", 1).alias("stem"), F.lit(rank).alias("rank"), F.trim("value").try_cast("double").alias("t"))
        out = v if out is None else out.unionAll(v)
    if out is None:
        raise ValueError("no patterns")
    bare = [(stem_of(name), rank, None) for rank, pattern in enumerate(patterns) for name in empty_files(spark, pattern)]
    g = out.unionAll(spark.createDataFrame(bare, "stem string, rank int, t double")).groupBy("stem", "rank").agg(F.array_sort(F.collect_list("t")).alias("values"))
    w = Window.partitionBy("stem").orderBy("rank")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("stem", "values")


def vectors(rows: DataFrame, key: str, time: str, name: str = "beats") -> DataFrame:
    """(stem, sorted times) from rows of a key, of which a .wav ending is taken off, and a time."""
    return rows.groupBy(F.regexp_replace(F.col(key), r"\.wav$", "").alias("stem")).agg(F.array_sort(F.collect_list(time)).alias(name))


def algorithm_beats(rows: DataFrame, algorithm: str | None = None) -> DataFrame:
    """(stem, beats) sorted, from rows of wav, beat_time_s and algorithm."""
    if algorithm is not None:
        rows = rows.where(F.col("algorithm") == algorithm)
    return vectors(rows, "wav", "beat_time_s")


def peak_vectors(rows: DataFrame) -> DataFrame:
    """(stem, peaks) sorted, from a peak table."""
    return vectors(rows, "stimulus_id", "peak_time_s", "peaks")


def window_peaks(rows: DataFrame, start: float, stop: float) -> DataFrame:
    """Peaks for a requested window: of the tightest analysis window that holds it (within 50 ms), else of one that equals it (20 ms), else of all."""
    holds = (F.col("window_t0") <= start + 0.05) & (F.col("window_t1") >= stop - 0.05)
    same = (F.abs(F.col("window_t0") - start) <= 0.02) & (F.abs(F.col("window_t1") - stop) <= 0.02)
    rank = F.when(holds, F.struct(F.lit(0).alias("k"), (F.col("window_t1") - F.col("window_t0")).alias("span"))).when(same, F.struct(F.lit(1).alias("k"), F.lit(0.0).alias("span"))).otherwise(F.struct(F.lit(2).alias("k"), F.lit(0.0).alias("span")))
    best = rows.withColumn("rank", rank)
    least = best.groupBy("stimulus_id").agg(F.min("rank").alias("least"))
    return best.join(least, "stimulus_id").where("rank = least").where(F.col("peak_time_s").between(start, stop)).select("stimulus_id", "peak_time_s").distinct()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(stem, corpus) under either of two key names; an empty one counts as absent."""
    df = spark.read.option("multiLine", True).json(path)
    either = lambda *names: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns))
    return df.select(either("stem_id", "stimulus_id").alias("stem"), either("dataset", "corpus").alias("corpus"))


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table, or an error that names what it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def experiment_nodes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each stem and condition, trimmed, with the path of its sound; an error names columns or files that are missing.

    files: path and stem of the sounds there are, as ``wav_headers`` gives them.
    """
    needed = ["stimulus_id", "condition", "corpus", "corpus_group", "audio_filename"]
    rows = required(manifest, needed).select(*(F.trim(F.col(c).cast("string")).alias(c) for c in needed))
    name = F.element_at(F.split("path", "/"), -1)
    found = rows.join(files.groupBy(name.alias("audio_filename")).agg(F.min("path").alias("path")), "audio_filename", "left")
    if lost := [r[0] for r in found.where("path is null").select("audio_filename").distinct().orderBy("audio_filename").limit(5).collect()]:
        raise FileNotFoundError(", ".join(map(str, lost)))
    return found.select(F.col("stimulus_id").alias("stem"), "condition", "corpus", "corpus_group", "path")


def sound_list(wanted: DataFrame, files: DataFrame, keep_missing: bool) -> DataFrame:
    """The wanted paths, each once, with whether they exist; those that don't are kept, as one tracker's list has it, or dropped, as the other's."""
    w = wanted.select(F.trim("path").alias("path")).where("path <> ''").distinct()
    return w.join(files.select("path", F.lit(True).alias("exists")).distinct(), "path", "left" if keep_missing else "inner").withColumn("exists", F.coalesce("exists", F.lit(False)))


def ragged(rows: DataFrame, values: str, offsets: str) -> DataFrame:
    """Arrays from one flat array and its offsets."""
    o = F.col(offsets)
    parts = F.transform(F.sequence(F.lit(1), F.size(o) - 1), lambda i: F.slice(F.col(values), F.element_at(o, i).cast("int") + 1, (F.element_at(o, i + 1) - F.element_at(o, i)).cast("int")))
    return rows.withColumn("parts", F.when(F.size(o) > 1, parts))


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Path, size and SHA-256 of files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"))


def config(text: str, env: dict[str, str] | None = None) -> dict:
    """A JSON object whose strings have ${NAME} replaced, at any depth; unknown names stay."""
    env = dict(os.environ) if env is None else env

    def expand(v):
        if isinstance(v, str):
            return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), v)
        if isinstance(v, dict):
            return {k: expand(x) for k, x in v.items()}
        return [expand(x) for x in v] if isinstance(v, list) else v

    return expand(json.loads(text))


def resolved(path: str, roots: Sequence[str], must_exist: bool = False) -> str:
    """An absolute path as it is, else under the first root that has it, else under the last one; driver-side, for small local files."""
    found = [path] if os.path.isabs(path) else [os.path.join(r, path) for r in roots]
    for p in found:
        if os.path.exists(p):
            return p
    if must_exist:
        raise FileNotFoundError(path)
    return found[-1]


def first_readable(spark: SparkSession, paths: Sequence[str], read) -> DataFrame:
    """The table of the first path that Spark can list; an error if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        p = hadoop.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return read(path)
    raise FileNotFoundError(", ".join(paths))


def merged_config(base: dict, over: dict) -> dict:
    """``over`` laid over a deep copy of ``base``: objects are merged, anything else is replaced."""
    out = {k: merged_config(v, {}) if isinstance(v, dict) else v for k, v in base.items()}
    for k, v in over.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def stem_tempo(rows: DataFrame, dataset: str) -> DataFrame:
    """(stem, bpm) of one data set's metadata; what is no number is left out."""
    return rows.where(F.lower(F.trim("dataset")) == dataset.lower()).select(F.trim("stem").alias("stem"), F.col("bpm").cast("string").try_cast("double").alias("bpm")).where("bpm is not null and not isnan(bpm)")


def source_countries(rows: DataFrame, stem: str = "stim_name", country: str = "source_country") -> DataFrame:
    """(stem, source_country), a row for each stem; of several countries the first by name."""
    return rows.groupBy(F.trim(F.col(stem)).alias("stem")).agg(F.min(F.trim(F.col(country))).alias("source_country"))


def split_roles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recruitment panels and music sources of one table of countries."""
    return rows.where(F.col("role") == "panel").drop("role"), rows.where(F.col("role") == "source").drop("role")


def wav_headers(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, stem, rate, channels, seconds) of WAV files, from the bytes of their headers; other files have nulls."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV}").option("recursiveFileLookup", recursive).load(path)
    le = lambda at, n: F.conv(F.concat(*(F.hex(F.substring("content", at + n - 1 - i, 1)) for i in range(n))), 16, 10).cast("long")
    is_wav = (F.substring("content", 1, 4).cast("string") == "RIFF") & (F.substring("content", 13, 4).cast("string") == "fmt ")
    when = lambda c: F.when(is_wav, c)
    return df.select("path", F.trim(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)).alias("stem"), when(le(25, 4)).alias("rate"), when(le(23, 2)).cast("int").alias("channels"), when((F.col("length") - 44) / le(29, 4)).alias("seconds"))


def located(stems: DataFrame, listing: DataFrame) -> DataFrame:
    """Stems with the path of their file, null where there is none; of several the first path."""
    first = listing.groupBy("stem").agg(F.min("path").alias("path"))
    return stems.join(first, "stem", "left")
