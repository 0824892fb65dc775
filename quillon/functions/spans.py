"""Spans as columns: offsets of matches, overlap measures, greedy choices. Offsets are code points, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,stop:int,match:string>>"


def let(value: Column, use) -> Column:
    """``use(value)``, the value computed once for a row."""
    return F.get(F.transform(F.array(value), use), 0)


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern without empty ones, as (start, stop, match).

    An array grows by copying, so places are summed in two levels: over runs of about sqrt(n) matches, and within each run.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    size = lambda p: F.size(p["hit"])

    def steps(p: Column) -> Column:
        """The matches, each with its distance from the match before."""
        return F.transform(p["hit"], lambda hit, k: F.struct(F.length(F.get(p["gap"], k)).alias("gap"), F.length(hit).alias("long"), hit.alias("match")))

    def runs(p: Column) -> Column:
        run = F.ceil(F.sqrt(size(p))).cast("int")
        return F.transform(F.sequence(F.lit(1), size(p), run), lambda first: F.slice(p["steps"], first, run))

    def heads(p: Column) -> Column:
        """Where each run begins."""
        length = F.transform(p["runs"], lambda run: F.aggregate(run, F.lit(0), lambda at, x: at + x["gap"] + x["long"]))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("heads"))
        add = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["heads"], F.array(s["at"])).alias("heads"))
        return F.aggregate(length, zero, add, lambda s: s["heads"])

    def within(run: Column, head: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["gap"]
            stop = start + x["long"]
            one = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["match"].alias("match")))
            return F.struct(stop.alias("at"), F.concat(s["found"], one).alias("found"))

        return F.aggregate(run, F.struct(head.alias("at"), F.array().cast(_SPANS).alias("found")), step, lambda s: s["found"])

    def found(p: Column) -> Column:
        return F.flatten(F.transform(p["runs"], lambda run, k: within(run, F.get(p["heads"], k))))

    with_steps = lambda p: F.struct(p["hit"].alias("hit"), steps(p).alias("steps"))
    with_runs = lambda p: F.struct(runs(p).alias("runs"))
    with_heads = lambda p: F.struct(p["runs"].alias("runs"), heads(p).alias("heads"))
    all_ = let(let(let(let(parts, with_steps), with_runs), with_heads), found)
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(_SPANS))


def shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (a1 > b0)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over joint length; 0 where disjoint."""
    both = shared(a0, a1, b0, b1)
    return F.when(both > 0, both / ((a1 - a0) + (b1 - b0) - both)).otherwise(F.lit(0.0))


def contained(p0: Column, p1: Column, g0: Column, g1: Column, share: float = 0.9) -> Column:
    """At least ``share`` of p lies in g."""
    return (p1 > p0) & (shared(p0, p1, g0, g1) >= share * (p1 - p0))


def claim(spans: Column, element: str) -> Column:
    """Of an array of structs with start, stop, in order of preference, those that overlap none taken before."""
    return F.aggregate(spans, F.array().cast(f"array<{element}>"), lambda kept, s: F.when(F.exists(kept, lambda k: (s["start"] < k["stop"]) & (s["stop"] > k["start"])), kept).otherwise(F.concat(kept, F.array(s))))


def pair_off(pairs: Column, element: str) -> Column:
    """Of an array of structs with g, p, in order of preference, a one-to-one choice."""
    return F.aggregate(pairs, F.array().cast(f"array<{element}>"), lambda kept, s: F.when(F.exists(kept, lambda k: (s["g"] == k["g"]) | (s["p"] == k["p"])), kept).otherwise(F.concat(kept, F.array(s))))
