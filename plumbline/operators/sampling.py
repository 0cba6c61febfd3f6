"""Deterministic sampling, splitting and what-if shifts.

Rows are ordered by a seeded hash of a unique key. A split is then a set of
cut-off hashes per class, found exactly by counting hash buckets, and every row
is assigned by comparing its own hash: no sort of the table, no window over a
giant class, any number of classes, and the same answer on every run and
cluster size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import SHIFT_PROFILES, SplitConfig
from plumbline.functions.columns import col
from plumbline.operators.ranks import values_at_ranks

# Leading bits of the hash that make up a bucket; a class has at most 2^16 buckets.
BUCKET_BITS = 16


def row_hash(key: str | list[str], seed: int) -> Column:
    keys = [key] if isinstance(key, str) else key
    return F.xxhash64(*[col(k) for k in keys], F.lit(seed))


def apportion(table: DataFrame, size: str, total: int, name: str) -> DataFrame:
    """Add ``name``: ``total`` split over the rows of a class table in proportion to ``size``, by largest remainder.

    Ties go to the class that sorts first as text. The classes that get one more
    are found by a top-k over the class table.
    """
    everything = table.agg(F.sum(size)).first()[0] or 0
    if not everything:
        return table.withColumn(name, F.lit(0).cast("long"))
    product = F.col(size).cast("decimal(38,0)") * F.lit(total).cast("decimal(18,0)")
    whole = F.floor(product / F.lit(everything)).cast("long")
    exact = F.lit(everything).cast("decimal(18,0)")
    left = (F.lit(total).cast("decimal(18,0)") * F.col(size).cast("decimal(18,0)") - whole.cast("decimal(18,0)") * exact).cast("decimal(38,0)")
    out = table.withColumns({name: whole, "_left": left})
    spare = total - (out.agg(F.sum(name)).first()[0] or 0)
    if spare > 0:
        more = out.orderBy(F.col("_left").desc(), "_class").limit(spare).select("_class", F.lit(1).alias("_one"))
        out = out.join(more, "_class", "left").withColumn(name, F.col(name) + F.coalesce("_one", F.lit(0))).drop("_one")
    return out.drop("_left")


def _class_key(label: str) -> Column:
    """The class as text, with a name of its own for missing labels."""
    return F.coalesce(F.concat(F.lit("="), col(label).cast("string")), F.lit("null"))


def _assign(df: DataFrame, label: str, h: Column, cuts_of) -> DataFrame:
    """(_row, _part): part number of each row, that is how many of its class's cut ranks its hash has passed.

    ``cuts_of`` turns the class table (``_class``, ``size``) into (``_class``,
    ``cuts``). Hash buckets are counted per class, which tells in which bucket
    each cut falls; only rows of those buckets are ranked, so that a class with
    most of the rows is spread over its buckets. The cut-off hashes (a few per
    class) are then joined to the rows; a frequent class is split by the join.
    """
    bucket = F.shiftright("_h", 64 - BUCKET_BITS)
    # The user's row stays in one column, so that its names can't meet those made here.
    keyed = df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"), _class_key(label).alias("_class"), h.alias("_h"))
    counts = keyed.groupBy("_class", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("_class").agg(F.sum("n").alias("size"))
    cuts = cuts_of(sizes).select("_class", F.posexplode("cuts").alias("_cut", "_rank"))
    running = F.sum("n").over(Window.partitionBy("_class").orderBy("_bucket"))
    placed = counts.withColumn("_before", running - F.col("n")).join(cuts, "_class")
    placed = placed.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("n")))
    placed = placed.select("_class", "_bucket", (F.col("_rank") - F.col("_before")).alias("_offset"))
    within = keyed.select("_class", "_h", bucket.alias("_bucket")).join(placed.select("_class", "_bucket").distinct(), ["_class", "_bucket"], "left_semi")
    order = Window.partitionBy("_class", "_bucket").orderBy("_h")
    within = within.withColumn("_offset", F.row_number().over(order) - 1)
    limits = within.join(placed, ["_class", "_bucket", "_offset"]).groupBy("_class").agg(F.collect_list("_h").alias("_limits"))
    # A cut at or past the end of a class has no limit: the later parts stay empty.
    passed = F.size(F.filter("_limits", lambda x: x <= F.col("_h")))
    # One row per class; a class has no limits only when all its cuts are past its end.
    part = F.coalesce(F.when(F.col("_limits").isNotNull(), passed), F.lit(0))
    return keyed.join(limits, "_class", "left").select("_row", part.alias("_part"))


def _with_part(df: DataFrame, assigned: DataFrame, name: str, part: Column) -> DataFrame:
    """The rows as they came, with ``name`` added or replaced."""
    return assigned.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c != name], part.alias(name))


def stratified_split(
    df: DataFrame, label: str, key: str | list[str], cfg: SplitConfig = SplitConfig(), name: str = "split"
) -> DataFrame:
    """Add train / validation / test with the class mix kept in every part.

    Part sizes are floor(train * n) for train and, of the rest, the test share
    rounded up. ``key`` must identify a row.
    """
    if round(cfg.train + cfg.validation + cfg.test, 10) != 1.0:
        raise ValueError(f"split sizes must add up to 1: {cfg}")
    return _split(df, label, key, cfg, name, ["train", "validation", "test"])


def train_test_split(
    df: DataFrame, label: str, key: str | list[str], test: float = 0.20, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Stratified two-way split; the test share is rounded up."""
    return _split(df, label, key, SplitConfig(1 - test, 0.0, test, seed), name, ["train", "test"])


def _split(df, label, key, cfg: SplitConfig, name: str, parts: list[str]) -> DataFrame:
    def cuts_of(sizes: DataFrame) -> DataFrame:
        n = sizes.agg(F.sum("size")).first()[0] or 0
        if len(parts) == 2:
            table = apportion(sizes, "size", n - math.ceil(n * cfg.test - 1e-9), "train")
            return table.select("_class", F.array("train").alias("cuts"))
        table = apportion(sizes, "size", math.floor(n * cfg.train + 1e-9), "train").withColumn("rest", F.col("size") - F.col("train"))
        left = table.agg(F.sum("rest")).first()[0] or 0
        table = apportion(table, "rest", math.ceil(left * cfg.test / (cfg.validation + cfg.test) - 1e-9) if left else 0, "test")
        return table.select("_class", F.array("train", F.col("size") - F.col("test")).alias("cuts"))

    assigned = _assign(df, label, row_hash(key, cfg.seed), cuts_of)
    return _with_part(df, assigned, name, F.get(F.array(*[F.lit(p) for p in parts]), F.col("_part")))


def stratified_folds(
    df: DataFrame, label: str, key: str | list[str], k: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1; fold sizes differ by at most one row within a class."""
    def cuts_of(sizes: DataFrame) -> DataFrame:
        ranks = [F.ceil(F.col("size") * j / F.lit(k)).cast("long") for j in range(1, k)]
        return sizes.select("_class", F.array(*ranks).alias("cuts"))

    if k < 2:
        return df.withColumn(name, F.lit(0))
    return _with_part(df, _assign(df, label, row_hash(key, seed), cuts_of), name, F.col("_part"))


def split_summary(df: DataFrame, label: str, by: str = "split") -> DataFrame:
    """Rows, positives and positive rate (percent) per part."""
    return df.groupBy(col(by)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(col(label)).cast("long").alias("positives"),
        F.round(F.avg(col(label)) * 100, 2).alias("positive_rate"),
    )


def _row_text(df: DataFrame) -> Column:
    """Everything in a row as text; equal rows, and only these, have the same."""
    return F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})


@dataclass(frozen=True)
class _Cut:
    """Where a slice ends: rows of a lesser order value come before, of rows with this very value those of a lesser tie-break, and of rows
    equal in both the first ``copies``."""

    value: int
    tie: int | None = None
    copies: int = 0

    def before(self, order: Column, tie: Column) -> Column:
        less = order < F.lit(self.value)
        return less if self.tie is None else less | ((order == F.lit(self.value)) & (tie < F.lit(self.tie)))

    def at(self, order: Column, tie: Column) -> Column:
        return (order == F.lit(self.value)) & (tie == F.lit(self.tie))


def _cuts(df: DataFrame, order: Column, tie: Column, ranks: list[int]) -> list[_Cut | None]:
    """The cut in front of each of the ascending ranks; None at or past the end."""
    size = max(df.count(), 1)
    found = values_at_ranks(df, {"o": order}, [min(r / size, 1.0) for r in ranks], lambda *_: ranks, dtype="bigint")["o"]
    inside = [r for r in ranks if r < found.n]
    # Ranks among the rows of one order value: repeated keys, or keys of one hash.
    split = {r: (found.values[r], r - found.below[r]) for r in inside if r > found.below[r]}
    ties = {}
    if split:
        names = {f"t{i}": r for i, r in enumerate(split)}
        parts = {name: F.when(order == F.lit(split[r][0]), tie) for name, r in names.items()}
        among = df.where(order.isin(*{v for v, _ in split.values()}))
        got = values_at_ranks(among, parts, [0.0, 0.5, 1.0], lambda name, _: [split[names[name]][1]], dtype="bigint")
        ties = {r: (got[name].values[split[r][1]], split[r][1] - got[name].below[split[r][1]]) for name, r in names.items()}
    return [_Cut(found.values[r], *ties.get(r, (None, 0))) if r < found.n else None for r in ranks]


def _copies(df: DataFrame, where: Column, first: int, behind: int | None) -> DataFrame:
    """Copies ``first`` .. ``behind - 1`` of the rows of one order value and tie-break, which are counted and not moved one by one."""
    rows = df.where(where)
    same = rows.groupBy(_row_text(df).alias("text")).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[col(c) for c in df.columns])).alias("row"))
    # Rows that differ and still have both hashes in common: hardly ever more than one kind.
    start = F.sum("n").over(Window.orderBy("text")) - F.col("n")
    end = F.col("n") + F.col("start")
    behind_here = end if behind is None else F.least(end, F.lit(behind))
    taken = same.withColumn("start", start).withColumn("taken", (behind_here - F.greatest(F.col("start"), F.lit(first))).cast("int"))
    return taken.where("taken > 0").select("row", F.explode(F.sequence(F.lit(1), "taken"))).select("row.*")


def _slices(df: DataFrame, order: Column, bounds: list[int]) -> list[DataFrame]:
    """Rows ``bounds[i]`` .. ``bounds[i + 1] - 1`` in the order of ``order``, then of the whole row.

    Cut-offs come from rank search, so a slice may be as large as the table.
    """
    tie = F.xxhash64(_row_text(df))
    cuts, out = _cuts(df, order, tie, bounds), []
    for low, high in zip(cuts, cuts[1:]):
        if low is None:
            out.append(df.where(F.lit(False)))
            continue
        keep = ~low.before(order, tie)
        if high is not None:
            keep = keep & high.before(order, tie)
        whole, parts = keep, []
        if low.copies:
            whole = whole & ~low.at(order, tie)
            together = high is not None and (high.value, high.tie) == (low.value, low.tie)
            parts.append(_copies(df, low.at(order, tie), low.copies, high.copies if together else None))
        else:
            together = False
        if high is not None and high.copies and not together:
            parts.append(_copies(df, high.at(order, tie), 0, high.copies))
        rows = df.where(whole)
        for part in parts:
            rows = rows.unionByName(part)
        out.append(rows)
    return out


def first_rows(df: DataFrame, order: Column, n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` .. ``skip + n - 1`` in the order of a whole-number expression; rows equal in it follow a hash of the whole row.

    Always min(n, rows left) rows: of rows that are equal altogether as many copies as are needed.
    """
    return _slices(df, order, [skip, skip + max(n, 0)])[0] if n > 0 else df.where(F.lit(False))


def seeded_sample(df: DataFrame, key: str | list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones on every run; the key may repeat."""
    return first_rows(df, row_hash(key, seed), n)


def sample_slices(
    df: DataFrame, key: str | list[str], sizes: list[int], seed: int = 42
) -> list[DataFrame]:
    """Disjoint consecutive slices of the hash order; the key may repeat."""
    return _slices(df, row_hash(key, seed), [sum(sizes[:i]) for i in range(len(sizes) + 1)])


def full_shift(df: DataFrame, add: dict[str, float] | None = None, overwrite: dict[str, str] | None = None) -> DataFrame:
    """Shift every row: add to numeric columns, overwrite categorical ones; absent columns are ignored."""
    changes = {n: col(n) + F.lit(d) for n, d in (add or {}).items() if n in df.columns}
    changes |= {n: F.lit(v) for n, v in (overwrite or {}).items() if n in df.columns}
    return df.withColumns(changes) if changes else df


def partial_shift(
    df: DataFrame,
    order: Column,
    numeric: str,
    categorical: str,
    category: str,
    strength: str = "Medium",
    flag: str | None = None,
) -> DataFrame:
    """Shift the first max(1, floor(share * n)) rows of ``order`` by a named profile.

    An unknown strength means Medium.
    """
    share, delta = SHIFT_PROFILES.get(strength, SHIFT_PROFILES["Medium"])
    found = values_at_ranks(
        df, {"o": order}, [share], lambda _, n: [max(1, int(n * share))], dtype="bigint"
    )["o"]
    cut = found.values.get(max(1, int(found.n * share)))
    hit = F.lit(True) if cut is None else order < F.lit(cut)
    changes = {}
    if numeric in df.columns:
        changes[numeric] = F.when(hit, col(numeric).try_cast("double") + F.lit(delta)).otherwise(col(numeric).cast("double"))
    if categorical in df.columns:
        changes[categorical] = F.when(hit, F.lit(category)).otherwise(col(categorical))
    if flag:
        changes[flag] = hit
    return df.withColumns(changes)
