"""Spans of pattern matches in texts, in code points, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<s:int,e:int,m:string>>"
#: Code points of a block.
BLOCK = 2048
#: s: start, k: rank of the kind, e: end (exclusive), kind
SPANS = "array<struct<s:int,k:int,e:int,kind:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(xs: Column, op: Callable[[Column, Column], Column], none: Column) -> Column:
    """Running totals of an array by an associative op with neutral element none: n log n steps, as arrays are copied log n times."""

    def whole(held: Column) -> Column:
        n = F.size(held)
        steps = F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)
        shifted = lambda acc, k: F.concat(F.array_repeat(none, F.call_function("shiftleft", F.lit(1), k)), F.slice(acc, F.lit(1), n - F.call_function("shiftleft", F.lit(1), k)))
        return F.when(n < 2, held).otherwise(F.aggregate(steps, held, lambda acc, k: F.zip_with(shifted(acc, k), acc, op)))

    return let(xs, whole)


def summed(xs: Column) -> Column:
    return scanned(xs, lambda a, b: a + b, F.lit(0))


def greatest_so_far(xs: Column) -> Column:
    return scanned(xs, lambda a, b: F.greatest(a, b), F.lit(0))


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches. split() yields what lies between them, so the running lengths of
    both give the positions. gate: where it doesn't hold, no match is looked for."""
    none = F.array().cast(MATCHES)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct((F.length(gap) + F.coalesce(F.length(m), F.lit(0))).alias("n"), m.alias("m")))

    def placed(found: Column) -> Column:
        ends = summed(F.transform(found, lambda x: x["n"]))
        spans = F.zip_with(found, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m")))
        return F.filter(spans, lambda x: x["m"].isNotNull())

    found = let(pairs, placed)
    return F.coalesce(F.when(F.coalesce(gate, F.lit(False)), found) if gate is not None else found, none)


def of_kind(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def in_order(*parts: Column) -> Column:
    """By start, then kind as listed, then end."""
    return F.array_sort(F.concat(*[p.cast(SPANS) for p in parts]))


def without_overlap(candidates: Column, base: Column) -> Column:
    """The candidates (structs with s and e) that share no character with a base span, in order of s.

    Both are merged by start: a base span that starts no later reaches in if the greatest end so far does, and one
    that starts later if the least start from there on lies before the candidate's end.
    """
    far = F.lit(2**31 - 1)
    row = lambda x, c: F.struct(x["s"].alias("s"), c.isNotNull().alias("own"), x["e"].alias("e"), c.alias("c"))

    def free(found: Column) -> Column:
        nothing = F.element_at(found, 1)["c"]
        merged = F.array_sort(F.concat(F.transform(found, lambda x: row(x["c"], x["c"])), F.transform(base, lambda b: row(b, F.when(F.lit(False), nothing)))))

        def judged(every: Column) -> Column:
            reach = greatest_so_far(F.transform(every, lambda x: F.when(x["own"], 0).otherwise(x["e"])))
            start = F.reverse(scanned(F.reverse(F.transform(every, lambda x: F.when(x["own"], far).otherwise(x["s"]))), lambda a, b: F.least(a, b), far))
            kept = F.filter(F.arrays_zip(every.alias("x"), reach.alias("r"), start.alias("t")), lambda z: z["x"]["own"] & (z["r"] <= z["x"]["s"]) & (z["t"] >= z["x"]["e"]))
            return F.transform(kept, lambda z: z["x"]["c"])

        return let(merged, judged)

    wrapped = F.transform(candidates, lambda c: F.struct(c.alias("c")))
    return F.when((F.size(candidates) > 0) & (F.size(base) > 0), let(wrapped, free)).otherwise(candidates)


def runs(ordered: Column) -> Column:
    """Spans in order, those that overlap put together: from the first start to the greatest end, of the first one's kind."""

    def joined(spans: Column) -> Column:
        def cut(reach: Column) -> Column:
            n = F.size(spans)
            begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(spans, i)["s"] >= F.element_at(reach, F.greatest(i - 1, F.lit(1)))))
            pairs = lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(n + 1)), lambda i, j: F.struct(i.alias("i"), j.alias("j")))
            one = lambda z: F.struct(F.element_at(spans, z["i"])["s"].alias("s"), F.element_at(spans, z["i"])["k"].alias("k"), F.element_at(reach, z["j"] - 1).alias("e"), F.element_at(spans, z["i"])["kind"].alias("kind"))
            return let(begins, lambda b: F.transform(pairs(b), one))

        return let(greatest_so_far(F.transform(spans, lambda x: x["e"])), cut)

    return F.when(F.size(ordered) < 2, ordered).otherwise(let(ordered, joined))


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a part of it is found without walking through all before."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def part(of: Column, start: Column, n: Column) -> Column:
    """n code points of blocks from start (0: the first)."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + F.greatest(n, F.lit(1)) - 1) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(of, first + 1, last - first + 1), ""), start - first * BLOCK + 1, n)


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of the first: <email>."""

    def replaced(own: Column, of: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(own, lambda x: x["e"]))
        filled = F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda x, e: F.concat(part(of, e, x["s"] - e), F.lit("<"), x["kind"], F.lit(">")))
        end = F.element_at(own, -1)["e"]
        return F.concat(F.array_join(filled, ""), part(of, end, F.length(text) - end))

    return F.when(F.size(spans) > 0, let(runs(spans), lambda own: let(blocks(text), lambda of: replaced(own, of)))).otherwise(text)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
