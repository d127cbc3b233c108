"""Scalar expressions: rounding, boolean texts, period classes, angles, positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean false, and those that mean true (fixed values).
FALSEY = ("", "false", "0", "nan", "<na>", "none")
TRUTHY = ("true", "1", "1.0")


def half_even(x: Column, places: int) -> Column:
    """Round half to even, as the released tables do."""
    return F.rint(x * float(10**places)) / float(10**places)


def flag_text(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string")))


def is_falsey(x: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(flag_text(x), F.lit("")).isin(*FALSEY)


def is_truthy(x: Column) -> Column:
    return F.coalesce(flag_text(x).isin(*TRUTHY), F.lit(False))


def number_list(text: Column) -> Column:
    """A JSON list of numbers: bad text, nulls, words and non-finite items are left out."""
    items = F.from_json(text, "array<string>")
    cast = F.transform(items, lambda x: x.try_cast("double"))
    return F.coalesce(F.filter(cast, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.array().cast("array<double>"))


def seconds_to_ms(values: Column) -> Column:
    """Lists whose largest size is under 100 are in seconds."""
    largest = F.array_max(F.transform(values, F.abs))
    return F.when(largest < 100, F.transform(values, lambda x: x * 1000.0)).otherwise(values)


def row_filter(rule: str | None, position: Column) -> Column:
    """``pos>=k``, ``pos==k`` or ``pos in {a,b}``; None keeps all, anything else is an error."""
    if rule is None:
        return F.lit(True)
    text = rule.replace(" ", "")
    if m := re.fullmatch(r"pos(>=|==)(\d+)", text):
        k = int(m[2])
        return position >= k if m[1] == ">=" else position == k
    if m := re.fullmatch(r"posin\{(\d+(?:,\d+)*)\}", text):
        return position.isin(*map(int, m[1].split(",")))
    raise ValueError(f"unknown row filter: {rule}")


def row_filter_by(rule: Column, position: Column) -> Column:
    """The same language where each row brings its rule; null lets everything pass, and what is none of it is an error."""
    r = F.replace(rule, F.lit(" "), F.lit(""))
    listed = F.transform(F.filter(F.split(F.regexp_extract(r, r"\{(.*)\}", 1), ","), lambda x: x != ""), lambda x: x.cast("int"))
    return (
        F.when(rule.isNull(), True)
        .when(r.rlike("^pos>=-?[0-9]+$"), position >= F.substring(r, 6, 20).try_cast("int"))
        .when(r.rlike("^pos==-?[0-9]+$"), position == F.substring(r, 6, 20).try_cast("int"))
        .when(r.rlike("^posin\\{[-0-9,]*\\}$"), F.array_contains(listed, position))
        .otherwise(F.raise_error(F.concat(F.lit("unknown row filter: "), rule)).cast("boolean"))
    )


def metric_relation(reference: Column, predicted: Column) -> Column:
    """Audit classes of a period ratio, in order of precedence."""
    r = predicted / reference
    near = lambda x, tol: F.abs(r - x) <= tol
    return (
        F.when(reference.isNull() | predicted.isNull() | (reference <= 0), "missing")
        .when(near(1.0, 0.05), "same")
        .when(near(0.5, 0.05), "double")
        .when(near(2.0, 0.10), "half")
        .when(near(1.5, 0.05) | near(2.0 / 3.0, 0.05), "triplet/2")
        .otherwise("other")
    )


def ratio_class(r: Column) -> Column:
    """Panel classes of a period ratio."""
    return F.when(r.isNull() | (r <= 0), "unclear").when(r.between(0.35, 0.65), "double").when(r.between(0.80, 1.25), "matched").when(r.between(1.75, 2.25), "half").otherwise("other")


def octave_class(r: Column) -> Column:
    """Classes by distance in octaves."""
    o = F.log2(r)
    return F.when(r.isNull() | (r <= 0), "missing").when(F.abs(o) < 0.15, "match").when(F.abs(o - 1) < 0.15, "half").when(F.abs(o + 1) < 0.15, "double").otherwise("other_flip")


def wrap_cycles(x: Column) -> Column:
    """Phase in cycles, wrapped to [-1/2, 1/2)."""
    return x + 0.5 - F.floor(x + 0.5) - 0.5
