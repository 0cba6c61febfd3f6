"""Exact values at given ranks, without a global sort.

``percentile`` keeps every distinct value of a group in one task's memory, and
a global ``row_number`` sorts the whole table in one task. Both stop working
long before 100 TB. Here the value at a rank is pinned down in three passes,
each of which shuffles only a summary:

1. sketch: one KLL sketch per column gives a few cut values tightly around
   every wanted rank;
2. count: rows between neighbouring cuts are counted (map-side combined), which
   tells exactly which narrow interval holds each wanted rank;
3. pinpoint: only rows inside those intervals are grouped by value, and a
   running count inside each interval finds the value. An interval that still
   holds too many rows for one task is first narrowed by steps 1 and 2 again.

The result is exact whatever the sketch returns; a poor sketch only makes the
last pass read more. Hot values cost nothing extra: a cut value gets an interval
of its own, and pass 3 works on (value, count) pairs. What reaches the driver is
a few dozen numbers per column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import literal, local_table

# Sketch size, and how far around a wanted rank the cuts are laid (as a fraction
# of the rows; well above the rank error of a sketch of this size).
SKETCH_K = 4096
PAD = 0.002
# An interval with more rows than this is narrowed again, up to a depth at which
# it can only hold a few distinct values.
MAX_PINPOINT_ROWS = 2_000_000
MAX_DEPTH = 8


@dataclass
class Ranked:
    """Outcome for one column: row count, value by rank, and extra aggregates.

    ``below`` counts the rows with a smaller value than the one found.
    """

    n: int
    values: dict[int, float] = field(default_factory=dict)
    below: dict[int, int] = field(default_factory=dict)
    extra: dict[str, object] = field(default_factory=dict)


def _bucketed(wide: DataFrame, cuts: dict[str, list]) -> DataFrame:
    """(series, v, bucket): bucket = number of cuts at or below the value.

    ``Bucketizer`` does a binary search in the JVM; a chain of comparisons over
    dozens of cuts makes generated methods too long to be compiled.
    """
    names = list(cuts)
    edges = [[-math.inf, *(float(c) for c in cuts[k]), math.inf] for k in names]
    placed = Bucketizer(
        splitsArray=edges,
        inputCols=names,
        outputCols=[f"b_{k}" for k in names],
        handleInvalid="keep",
    ).transform(wide)
    cells = [
        F.struct(F.lit(k).alias("series"), F.col(f"b_{k}").cast("int").alias("bucket"), F.col(k).alias("v"))
        for k in names
    ]
    return placed.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())


def _within(name: str, limits: tuple, dtype: str) -> str:
    return f"{name} BETWEEN {literal(limits[0], dtype)} AND {literal(limits[1], dtype)}"


def values_at_ranks(
    df: DataFrame,
    columns: dict[str, Column],
    near: Iterable[float],
    ranks: Callable[[str, int], Iterable[int]],
    dtype: str = "double",
    extra: dict[str, Callable[[Column], Column]] | None = None,
    depth: int = 0,
) -> dict[str, Ranked]:
    """Value at each 0-based rank of each column (nulls left out).

    ``near`` lists the fractions of the row count around which the ranks lie;
    it steers the sketch only. ``ranks(name, n)`` names the ranks once the row
    count is known. ``extra`` adds plain aggregates to the first pass. ``dtype``
    is ``double`` or ``bigint``.
    """
    extra = extra or {}
    keys = {f"c{i}": name for i, name in enumerate(columns)}
    wide = df.select(*[columns[name].cast(dtype).alias(k) for k, name in keys.items()])
    probes = F.array(
        *[F.lit(p) for p in sorted({min(1.0, max(0.0, p + d)) for p in near for d in (-PAD, PAD)})]
    )
    sketch = F.kll_sketch_agg_bigint if dtype == "bigint" else F.kll_sketch_agg_double
    read = F.kll_sketch_get_quantile_bigint if dtype == "bigint" else F.kll_sketch_get_quantile_double

    aggregates = []
    for k in keys:
        aggregates.append(F.count(k).alias(f"n_{k}"))
        aggregates.append(sketch(k, SKETCH_K).alias(f"s_{k}"))
        aggregates += [fn(F.col(k)).alias(f"x_{label}_{k}") for label, fn in extra.items()]
    sketched = wide.agg(*aggregates)
    first = sketched.select(
        *[c for c in sketched.columns if not c.startswith("s_")],
        *[F.when(F.col(f"n_{k}") > 0, read(f"s_{k}", probes)).alias(f"cuts_{k}") for k in keys],
    ).first()

    out = {
        name: Ranked(first[f"n_{k}"], extra={x: first[f"x_{x}_{k}"] for x in extra})
        for k, name in keys.items()
    }
    wanted = {
        k: sorted({r for r in ranks(name, out[name].n) if 0 <= r < out[name].n})
        for k, name in keys.items()
        if out[name].n
    }
    wanted = {k: rs for k, rs in wanted.items() if rs}
    if not wanted:
        return out
    cuts = {
        k: sorted({x for c in first[f"cuts_{k}"] for x in (float(c), math.nextafter(float(c), math.inf))})
        for k in wanted
    }

    spans = (
        _bucketed(wide.select(*wanted), cuts)
        .groupBy("series", "bucket")
        .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    open_ranks: dict[tuple[str, int], list[int]] = {}
    bounds: dict[tuple[str, int], tuple] = {}
    sizes: dict[tuple[str, int], int] = {}
    offset: dict[tuple[str, int], int] = {}
    for k in wanted:
        below = 0
        for span in sorted((s for s in spans if s["series"] == k), key=lambda s: s["bucket"]):
            spot = (k, span["bucket"])
            for r in (r for r in wanted[k] if below <= r < below + span["n"]):
                if span["lo"] == span["hi"] or r == below:
                    out[keys[k]].values[r] = span["lo"]
                    out[keys[k]].below[r] = below
                else:
                    open_ranks.setdefault(spot, []).append(r)
                    bounds[spot] = (span["lo"], span["hi"])
                    sizes[spot] = span["n"]
                    offset[spot] = below
            below += span["n"]
    if not open_ranks:
        return out

    wide_spots = [s for s in open_ranks if sizes[s] > MAX_PINPOINT_ROWS and depth < MAX_DEPTH]
    if wide_spots:
        parts = {f"p{i}": spot for i, spot in enumerate(wide_spots)}
        inside = {
            name: F.when(F.expr(_within(spot[0], bounds[spot], dtype)), F.col(spot[0])) for name, spot in parts.items()
        }
        local = {name: [r - offset[s] for r in open_ranks[s]] for name, s in parts.items()}
        where = {round(r / sizes[parts[name]], 4) for name, rs in local.items() for r in rs}
        nearby = " OR ".join(_within(s[0], bounds[s], dtype) for s in wide_spots)
        narrowed = values_at_ranks(
            wide.where(F.expr(nearby)), inside, where, lambda name, _: local[name], dtype, depth=depth + 1
        )
        for name, spot in parts.items():
            found = out[keys[spot[0]]]
            for r, value in narrowed[name].values.items():
                found.values[r + offset[spot]] = value
                found.below[r + offset[spot]] = narrowed[name].below[r] + offset[spot]
            del open_ranks[spot], bounds[spot]
        if not open_ranks:
            return out

    # The value intervals are literals, so the scan can skip row groups by them.
    series = sorted({k for k, _ in open_ranks})
    nearby = " OR ".join(_within(k, limits, dtype) for (k, _), limits in bounds.items())
    wanted_rows = [(k, b, r - offset[(k, b)]) for (k, b), rs in open_ranks.items() for r in rs]
    # A few targets per column.
    targets = F.broadcast(local_table(df.sparkSession, wanted_rows, "series string, bucket int, target bigint"))
    intervals = local_table(df.sparkSession, list(open_ranks), "series string, bucket int")
    running = Window.partitionBy("series", "bucket").orderBy("v")
    counted = (
        _bucketed(wide.select(*series).where(F.expr(nearby)), {k: cuts[k] for k in series})
        .join(F.broadcast(intervals), ["series", "bucket"], "left_semi")
        .groupBy("series", "bucket", "v")
        .agg(F.count("v").alias("n"))
        .withColumn("below", F.sum("n").over(running) - F.col("n"))
    )
    hits = counted.join(targets, ["series", "bucket"]).where("below <= target AND target < below + n")
    for row in hits.select("series", "bucket", "v", "below", "target").collect():
        spot = (row["series"], row["bucket"])
        found = out[keys[spot[0]]]
        found.values[row["target"] + offset[spot]] = row["v"]
        found.below[row["target"] + offset[spot]] = offset[spot] + row["below"]
    return out


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    fractions: list[float],
    extra: dict[str, Callable[[Column], Column]] | None = None,
) -> dict[str, Ranked]:
    """Linear-interpolated quantiles; results are keyed by position in ``fractions``.

    A quantile lies between two neighbouring order statistics, so the number of
    rows below it follows from theirs and needs no further pass.
    """

    def neighbours(_: str, n: int) -> list[int]:
        lows = [math.floor((n - 1) * p) for p in fractions]
        return lows + [min(low + 1, n - 1) for low in lows]

    found = values_at_ranks(df, columns, fractions, neighbours, extra=extra)
    for ranked in found.values():
        by_rank, below_rank = ranked.values, ranked.below
        ranked.values, ranked.below = {}, {}
        for i, p in enumerate(fractions if ranked.n else []):
            spot = (ranked.n - 1) * p
            low = math.floor(spot)
            high = min(low + 1, ranked.n - 1)
            a, b = by_rank[low], by_rank[high]
            t = spot - low
            ranked.values[i] = a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)
            ranked.below[i] = below_rank[high] if ranked.values[i] > a else below_rank[low]
    return found
