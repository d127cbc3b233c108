"""From raw exports to usable trials: payloads, predicates, checks of one table against another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import number_list, row_filter_by, seconds_to_ms

PAYLOAD = "failed boolean, extracted_onsets string"


def aligned_taps(analysis: Column, key: str = "resp_onsets_aligned", offset_ms: float = 2000.0, stop_s: float = 30.0) -> Column:
    """Sorted seconds of music time from a nested payload; empty where ``failed`` is true, the text is bad or the key is absent.

    The inner object may be encoded once more.  Only a ``failed`` that is true
    excludes: an absent one keeps the trial.
    """
    outer = F.from_json(analysis, PAYLOAD)
    onsets = F.from_json(outer["extracted_onsets"], f"`{key}` array<double>")[key]
    finite = F.filter(onsets, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    seconds = F.transform(finite, lambda x: (x - offset_ms) / 1000.0)
    inside = F.array_sort(F.filter(seconds, lambda x: x.between(0.0, stop_s)))
    return F.when(F.coalesce(outer["failed"], F.lit(False)), F.array().cast("array<double>")).otherwise(F.coalesce(inside, F.array().cast("array<double>")))


def truth(value: Column, absent: bool) -> Column:
    """Whether a JSON value (variant) counts as true: null, 0, and what is empty do not; ``absent`` for none at all."""
    kind = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull(), absent)
        .when(F.is_variant_null(value), False)
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", as_text != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~F.to_json(value).isin("{}", "[]"))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def flattened_analysis(rows: DataFrame, analysis: str = "analysis") -> DataFrame:
    """``rows`` with analysis_failed, resp_onsets_aligned (JSON text) and analysis_reason from a nested payload.

    A missing payload failed, for the reason "missing"; one that can't be read
    failed, for the reason "parse_error"; a payload without ``failed`` failed too.
    The inner object may be encoded once more.  Absent reasons are empty.
    """
    whole = F.try_parse_json(F.col(analysis))
    rows = rows.withColumn("_a", whole)
    rows = rows.withColumns({"_failed": F.try_variant_get("_a", "$.failed", "variant"), "_eo": F.try_variant_get("_a", "$.extracted_onsets", "variant"), "_object": F.schema_of_variant("_a").startswith("OBJECT")})
    encoded = F.schema_of_variant("_eo") == "STRING"
    inner = F.when(encoded, F.try_parse_json(F.try_variant_get("_eo", "$", "string"))).otherwise(F.col("_eo"))
    rows = rows.withColumn("_inner", inner)
    bad = F.col(analysis).isNotNull() & (~F.coalesce("_object", F.lit(False)) | (F.coalesce(encoded, F.lit(False)) & F.col("_inner").isNull()))
    found = F.try_variant_get("_inner", "$.resp_onsets_aligned", "variant")
    ok = F.col(analysis).isNotNull() & ~bad
    reason = F.coalesce(F.try_variant_get("_a", "$.reason", "string"), F.when(F.try_variant_get("_a", "$.reason", "variant").isNull(), ""))
    out = rows.withColumns(
        {
            "analysis_failed": F.when(ok, truth(F.col("_failed"), True)).otherwise(True),
            "resp_onsets_aligned": F.when(ok & found.isNotNull() & ~F.is_variant_null(found), F.to_json(found)),
            "analysis_reason": F.when(F.col(analysis).isNull(), "missing").when(bad, "parse_error").otherwise(reason),
        }
    )
    return out.drop("_a", "_failed", "_eo", "_object", "_inner")


def mapped_references(beats: DataFrame, sources: DataFrame, clip_s: float = 30.0) -> DataFrame:
    """(stem, t, pos) of each stem's reference within its clip, by a map of sources.

    beats: path, t, pos (as ``readers.beat_files`` gives them, by path);
    sources: stem, path (null where a stem has no reference), row_filter and
    clip_offset_s (may be null).  The offset is taken off after the filter; a
    beat up to 1 ms before the clip counts as its start.
    """
    m = sources.where("path is not null").select("stem", "path", "row_filter", F.coalesce("clip_offset_s", F.lit(0.0)).alias("offset"))
    kept = beats.join(m, "path").where(row_filter_by(F.col("row_filter"), F.col("pos"))).withColumn("t", F.col("t") - F.col("offset"))
    return kept.where((F.col("t") >= -1e-3) & (F.col("t") < clip_s)).select("stem", F.greatest("t", F.lit(0.0)).alias("t"), "pos")


def canonical_stem(group: Column, audio: Column, name: Column) -> Column:
    """A trial's stem by its corpus group's naming: the sound's file name where its folder tells, else the stimulus name (fixed rules)."""
    base = lambda c: F.regexp_replace(F.element_at(F.split(F.trim(c), "/"), -1), r"(?<=.)\.[^.]*$", "")
    return (
        F.when(group == "ballroom", F.when(F.contains(audio, F.lit("ballroom_wav")), base(audio)).otherwise(name))
        .when(group == "mirex", F.when(F.contains(audio, F.lit("/mirex/")), base(audio)).otherwise(name))
        .when(group == "benchmark100", F.regexp_replace(name, "^[^/]*/", ""))
        .when(group == "globalmood40", F.trim(base(audio)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown corpus group: "), F.coalesce(group, F.lit("null")))))
    )


def quoted_list(text: Column) -> Column:
    """A list of numbers written with either kind of quotes, or as a Python literal."""
    return number_list(F.translate(text, "'()", '"[]'))


def tap_list_ms(row_keys: Sequence[Column]) -> Column:
    """The first candidate text with a number in it, as milliseconds; lists in seconds are scaled."""
    lists = [quoted_list(c) for c in row_keys]
    return seconds_to_ms(F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array().cast("array<double>")))


def strictly_not_failed(flag: Column) -> Column:
    """Only a false flag passes; null does not."""
    return F.coalesce(~flag, F.lit(False))


def ms_to_s(ms: Column, offset_s: float) -> Column:
    """Milliseconds to seconds first, then the offset."""
    return ms / 1000.0 - offset_s


def first_match(text: Column, mapping: Sequence[tuple[str, str]]) -> Column:
    """The value of the first key, in the order given, that the text contains; case counts."""
    out = F.lit(None).cast("string")
    for key, value in reversed(mapping):
        out = F.when(F.contains(text, F.lit(key)), F.lit(value)).otherwise(out)
    return out


def left_if(df: DataFrame, other: DataFrame | None, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Left join with an optional table; where it is absent its columns (name: type) are null."""
    if other is None:
        return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    return df.join(other.select(*keys, *columns), list(keys), "left")


def agreement(released: DataFrame, computed: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """For each column, rows in both tables and rows that agree: within the tolerance, or both null."""
    c = computed.select(*keys, *(F.col(x).alias(f"{x}_recomputed") for x in columns))
    j = released.select(*keys, *columns).join(c, list(keys))
    same = lambda x: F.coalesce(F.abs(F.col(x) - F.col(f"{x}_recomputed")) <= tolerance, F.col(x).isNull() & F.col(f"{x}_recomputed").isNull())
    counts = j.agg(F.count("*").alias("n"), *(F.count_if(same(x)).alias(x) for x in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(x).alias("column"), F.col("n").alias("n_rows"), F.col(x).alias("n_same")) for x in columns))).alias("r")).select("r.*")


def group_pairs(groups: DataFrame, key: str, value: str) -> DataFrame:
    """All pairs of groups, each once, with the difference of a value; ``groups`` has a row for each group."""
    a, b = (groups.select(F.lit(1).alias("one"), F.col(key).alias(n), F.col(value).alias(v)) for n, v in (("first", "x"), ("second", "y")))
    return a.join(b, "one").where("first < second").select("first", "second", (F.col("x") - F.col("y")).alias("difference"))
