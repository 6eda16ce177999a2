"""Scalar expressions over numbers, arrays and maps. Only erfc needs Python: Spark SQL has none."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def lrt_pvalue(alt: Column, null: Column) -> Column:
    """Chi-square with one degree of freedom of twice the difference of two log-likelihoods."""
    return erfc(F.sqrt(F.greatest(F.lit(0.0), alt - null)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; an error where the sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))


def merged_length(intervals: Column) -> Column:
    """How many positions 1-based inclusive intervals (arrays of structs lo, hi) cover together."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        lo = F.greatest(x["lo"].cast("long"), acc["upto"] + 1)
        hi = x["hi"].cast("long")
        more = F.greatest(hi - lo + 1, F.lit(0).cast("long"))
        return F.struct(F.greatest(acc["upto"], hi).alias("upto"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(F.array_sort(intervals), start, step, lambda acc: acc["sum"])


def coverage(intervals: Column, length: Column) -> Column:
    return F.when(length > 0, merged_length(intervals) / length).otherwise(F.lit(0.0))


def margin_required(best: Column, least: float = 10.0, fraction: float = 0.05) -> Column:
    return F.greatest(F.lit(least), F.lit(fraction) * best)


def member_digest(members: Column) -> Column:
    """SHA-1 of the sorted ids of an array, one a line."""
    return F.sha1(F.array_join(F.array_sort(members), "\n"))


def alignment_digest(rows: Column) -> Column:
    """16 hex digits of the SHA-256 over the sorted rows (structs seq_id, aligned) of an alignment."""
    lines = F.transform(F.array_sort(rows), lambda r: F.concat(r["seq_id"].cast("string"), F.lit("\t"), r["aligned"], F.lit("\n")))
    return F.left(F.sha2(F.array_join(lines, ""), 256), F.lit(16))


def alignment_stamp(digest: Column, n_columns: Column, n_sequences: Column) -> Column:
    return F.format_string("%s:%dx%d", digest, n_sequences, n_columns)


def top_location(label: Column, probs: Column, min_prob: float = 0.5) -> Column:
    """The most probable class if it reaches min_prob, else null; the label where there are no probabilities.

    Of equal probabilities the entry that comes first in the map wins.
    """
    entries = F.transform(F.map_entries(probs), lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("order"), e["key"].alias("name")))
    top = F.array_max(entries)
    empty = probs.isNull() | (F.size(probs) == 0)
    return F.when(empty, label).when(top["p"] >= min_prob, top["name"])


def usable_ec(is_enzyme: Column, ec: Column, confidence: Column, min_conf: float = 0.0) -> Column:
    return F.when(is_enzyme & (ec != "") & (confidence >= min_conf), ec)


def min_support(label: Column) -> Column:
    """The least number among the parts of a node label such as 0.98/87; null if none is a number."""
    return F.array_min(F.filter(F.transform(F.split(label, "/"), lambda x: x.try_cast("double")), lambda x: x.isNotNull()))


def fold_seconds(length: Column, max_len: int | None = None) -> Column:
    """Expected folding time of a sequence: 1.68 s at 210 residues, with the length to the power 2.55."""
    cost = F.lit(1.68) * F.pow(length / F.lit(210.0), F.lit(2.55))
    return cost if max_len is None else F.when(length <= max_len, cost).otherwise(F.lit(0.0))


def group_order(group: Column) -> list[Column]:
    """Sort keys that put numeric ids first, by number, and then the others by text."""
    number = group.try_cast("bigint")
    return [number.isNull().asc(), number.asc(), group.asc()]


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
