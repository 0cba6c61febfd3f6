"""Approximate nearest neighbours by inner product: a forest of random-projection trees and exact reranking.

1. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Equal vectors are one
   point of the index; of their rows only the k + 1 with the smallest ids are kept, because no result can hold more of them (the row
   that asks is left out of its own result).
2. Largest inner product becomes smallest angle: each vector gets one more component, so that all have the length of the longest; queries
   get 0 there.
3. Trees are fitted on a sample of at most `sample` points, those with the least hash. A node splits its points by the hyperplane
   halfway between two of them. Every point of the table is put into one leaf of each tree.
4. A query walks all trees through one queue that always opens the most promising node: the one whose worst margin on the way is best. It
   stops when the leaves opened so far, each counted in full, hold `share` times as many sampled points as the sample. This is the knob
   between effort and recall: vectors with close neighbours need little, evenly spread ones much. (tree, leaf) pairs join queries with
   points; points and queries of a leaf are dealt into groups of bounded size.
5. Pairs are scored exactly on the original vectors, in double precision. The first leaves of each query come first: their k + 1 best points
   are a bound, and of all further leaves only candidates that reach it are handed on. The best are the result, by score and then id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.tables import written

#: Points of a leaf, and queries that opened it, that are scored in one group.
GROUP, ASKING = 4096, 4096
#: Leaves of a query that are scored first.
FIRST_LEAVES = 4


@dataclass
class Tree:
    normals: np.ndarray  # a row per inner node
    offsets: np.ndarray
    children: np.ndarray  # two per inner node: another one, or -1 - leaf
    sizes: np.ndarray  # sampled points per leaf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of `x`."""
        at = np.zeros(len(x), np.int64) if len(self.normals) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            side = (np.einsum("ij,ij->i", x[open_], self.normals[node]) > self.offsets[node]).astype(int)
            at[open_] = self.children[node, side]
        return -1 - at


def grow(x: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    """A tree over the rows of `x` with at most about `leaf` rows per leaf (more only for equal rows)."""
    normals, offsets, children, sizes, stack = [], [], [], [], [(np.arange(len(x)), None, 0)]
    while stack:
        rows, parent, side = stack.pop()
        split = None
        for _ in range(4 if len(rows) > leaf else 0):
            a, b = x[random.choice(rows, 2, replace=False)]
            normal = a - b
            if not (norm := np.linalg.norm(normal)):
                continue
            normal = normal / norm
            offset = float(normal @ (a + b) / 2)
            right = x[rows] @ normal > offset
            if min(right.sum(), len(rows) - right.sum()) >= max(1, len(rows) // 20):
                split = normal, offset, right
                break
        if split is None and len(rows) > leaf:  # fall back to the middle of a random direction
            normal = random.standard_normal(x.shape[1])
            normal /= np.linalg.norm(normal)
            on = x[rows] @ normal
            right = on > np.median(on)
            if 0 < right.sum() < len(rows):
                split = normal, float(np.median(on)), right
        name = len(normals) if split else -1 - len(sizes)
        if parent is not None:
            children[parent][side] = name
        if split:
            normals.append(split[0])
            offsets.append(split[1])
            children.append([0, 0])
            stack += [(rows[~split[2]], name, 0), (rows[split[2]], name, 1)]
        else:
            sizes.append(len(rows))
    wide = x.shape[1]
    return Tree(np.array(normals).reshape(-1, wide), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(sizes, np.int64))


def visit(trees: list[Tree], q: np.ndarray, search: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of one shared queue, until they hold `search` sampled points."""
    queue = [(-np.inf, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < search:
        worst, t, node = heapq.heappop(queue)
        tree = trees[t]
        if node < 0:
            out.append((t, -1 - node))
            held += int(tree.sizes[-1 - node])
            continue
        margin = float(tree.normals[node] @ q - tree.offsets[node])
        # The near side keeps its margin on the way, the far side is as good as the distance across.
        heapq.heappush(queue, (max(worst, -margin), t, int(tree.children[node, 1])))
        heapq.heappush(queue, (max(worst, margin), t, int(tree.children[node, 0])))
    return out


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search_forest(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    trees: int = 12,
    leaf: int = 512,
    share: float = 1.2,
    sample: int = 100_000,
    seed: int = 11,
) -> DataFrame:
    """The `k` best rows of `vectors` for each row where `queries` holds: query_id, rank, `id_col`, score (inner product)."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & _usable(F.col("v")))
    sizes = {r["n"]: r["c"] for r in base.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).collect()}
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    width = max(sizes, key=lambda n: (sizes[n], n))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # A point is named by two hashes of its vector: 96 bits.
    base = base.where(F.size("v") == width).select("id", "v", "asks", F.struct(F.xxhash64("v").alias("h"), F.hash("v").alias("g")).alias("p"))
    order = Window.partitionBy("p").orderBy("id")
    kept = written(base.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("p", "v", "id"))
    asking = base.where("asks").select("p", "id")
    points = written(kept.groupBy("p").agg(F.first("v").alias("v"), F.min("id").alias("first"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("square", square))
    longest = points.agg(F.max("square")).first()[0]

    drawn = points.orderBy("p.h", "p.g").limit(sample).select("v", "square").toArrow()
    x = _matrix(drawn["v"].combine_chunks())
    x = np.hstack([x, np.sqrt(np.maximum(0, longest - drawn["square"].to_numpy()))[:, None]])
    random, search = np.random.default_rng(seed), int(np.ceil(share * len(x)))
    forest = spark.sparkContext.broadcast([grow(x, leaf, random) for _ in range(trees)])  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = _matrix(part.column("v"))
                x = np.hstack([x, np.sqrt(np.maximum(0, longest - part.column("square").to_numpy()))[:, None]])
                for t, tree in enumerate(forest.value):
                    yield pa.record_batch(
                        {"tree": pa.array([t] * len(x), pa.int32()), "leaf": pa.array(tree.leaves(x)), "p": part.column("p"), "v": part.column("v"), "first": part.column("first")}
                    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part, found, row, turn = batch.slice(a, 256), [], [], []
                for i, q in enumerate(_matrix(part.column("v"))):
                    opened = visit(forest.value, np.append(q / np.linalg.norm(q) * np.sqrt(longest), 0.0), search)
                    found += opened
                    row += [i] * len(opened)
                    turn += range(len(opened))
                row = pa.array(row, pa.int64())
                yield pa.record_batch(
                    {
                        "tree": pa.array([t for t, _ in found], pa.int32()),
                        "leaf": pa.array([n for _, n in found], pa.int64()),
                        "turn": pa.array(turn, pa.int32()),
                        "p": part.column("p").take(row),
                    }
                )

    kind = points.schema["v"].dataType.simpleString()
    name = "struct<h:bigint,g:int>"
    placed = written(points.drop("ids").mapInArrow(place, f"tree int, leaf long, p {name}, v {kind}, first long"))
    asked_points = points.join(asking.select("p").distinct(), "p", "left_semi").select("p", "v")
    wanted = written(asked_points.mapInArrow(ask, f"tree int, leaf long, turn int, p {name}"))
    # Both sides of a leaf are dealt into groups of bounded size.
    dealt = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    dealt = dealt.join(wanted.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("slots")), ["tree", "leaf"])
    columns = ["tree", "leaf", "part", "slot"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = placed.join(dealt, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int")).withColumn("slot", every("slots"))
    there = there.select(*columns, "p", "v", "first")

    def rerank(key: tuple, asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            y, first = np.stack(there["v"].to_list()).astype(np.float64), there["first"].to_numpy(np.int64)
            h, g = (np.array([p[c] for p in asked["p"]], np.int64) for c in "hg")
            bound = asked["bound"].to_numpy(np.float64)
            most = min(k + 1, len(there))
            for a in range(0, len(asked), 512):
                q = np.stack(asked["v"].iloc[a : a + 512].to_list()).astype(np.float64)
                scores = q @ y.T
                low = np.maximum(np.partition(scores, len(there) - most, axis=1)[:, len(there) - most], bound[a : a + 512])
                i, j = np.nonzero(scores >= low[:, None] - 1e-9 * np.abs(low[:, None]))  # ties stay
                # Summed again in one order, so that a pair has the same score in every leaf.
                out.append(pd.DataFrame({"h": h[a + i], "g": g[a + i], "first": first[j], "score": (q[i] * y[j]).sum(1)}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["h", "g", "first", "score"])

    def compared(opened: DataFrame) -> DataFrame:
        """Candidates of the opened leaves (tree, leaf, p, bound) that reach the bound: at most k + 1 of a group and query, but for ties."""
        asked = opened.join(asked_points, "p").join(dealt, ["tree", "leaf"]).withColumn("slot", F.pmod(F.xxhash64("p", F.lit(1)), F.col("slots")).cast("int"))
        asked = asked.withColumn("part", every("parts")).select(*columns, "p", "v", "bound")
        groups = asked.groupBy(*columns).cogroup(there.groupBy(*columns))
        return groups.applyInPandas(rerank, "h long, g int, first long, score double").groupBy("h", "g", "first").agg(F.max("score").alias("score"))

    # The first leaves of the queue give each query a score that its k-th best has at least; of all further leaves only what reaches it is
    # handed on, which is little.
    nearest = compared(wanted.where(F.col("turn") < FIRST_LEAVES).withColumn("bound", F.lit(float("-inf"))))
    reached = Window.partitionBy("h", "g").orderBy(F.desc("score"), "first")
    nearest = written(nearest.withColumn("nth", F.row_number().over(reached)).where(F.col("nth") <= k + 1))
    bounds = nearest.where(F.col("nth") == k + 1).select(F.struct("h", "g").alias("p"), F.col("score").alias("bound"))
    further = wanted.where(F.col("turn") >= FIRST_LEAVES).join(bounds, "p", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    pairs = nearest.drop("nth").unionByName(compared(further))
    # A point is named by its smallest id; it comes from several trees.
    pairs = pairs.groupBy("h", "g", "first").agg(F.max("score").alias("score"))
    best = Window.partitionBy("h", "g").orderBy(F.desc("score"), "first")
    pairs = pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    pairs = pairs.join(points.select("first", "ids"), "first").select("h", "g", "score", F.explode("ids").alias("found"))
    best = Window.partitionBy("h", "g").orderBy(F.desc("score"), "found")
    pairs = pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    hits = pairs.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("nth", "found", "score"))).alias("hits"))  # k + 1 of them at most
    asked = asking.select(F.col("id").alias("query_id"), "p.h", "p.g").join(hits, ["h", "g"])
    mine = F.slice(F.filter("hits", lambda x: x["found"] != F.col("query_id")), 1, k)
    return asked.select("query_id", F.posexplode(mine).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.found").alias(id_col), F.col("hit.score").alias("score")
    )
