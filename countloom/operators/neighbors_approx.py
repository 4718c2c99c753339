"""Approximate nearest neighbours in many dimensions: neighbour descent over a forest of random splits.

Exact search in many dimensions compares nearly all blocks. Here a point is compared only with those that share a small
leaf of some tree with it, and then, for a few rounds, with the neighbours of its neighbours. The number of distances is
in proportion to the number of points; ``recall`` measures what is lost against an exact search of sampled points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from countloom.operators.neighbors import nearest_rows, pair_distances
from countloom.session import cut_lineage

TASK_ROWS = 4096  # points of a node that one task splits to leaves


def _stack(column) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def _sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which of its node's two pivots each point is nearer to."""
    for batch in batches:
        if len(batch):
            x, p, q = (_stack(batch[c]) for c in ("vec", "p", "q"))
            nearer = ((x - q) ** 2).sum(axis=1) < ((x - p) ** 2).sum(axis=1)
            yield pd.DataFrame({"id": batch["id"], "tree": batch["tree"], "node": 2 * batch["node"] + 1 + nearer})


def _split(x: np.ndarray, rows: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows cut by bisectors of drawn pairs into leaves; where three draws cut nothing off, as among copies, by number."""
    todo = [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf_rows:
            yield rows
            continue
        for _ in range(3):
            p, q = x[rng.choice(rows, 2, replace=False)]
            nearer = ((x[rows] - q) ** 2).sum(axis=1) < ((x[rows] - p) ** 2).sum(axis=1)
            if nearer.any():
                todo += [rows[nearer], rows[~nearer]]
                break
        else:
            yield from np.array_split(rows, -(-len(rows) // leaf_rows))


def _leaves(leaf_rows: int, seed: int):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("id")  # the same leaves whatever order the rows arrive in
        tree, node, part = int(batch["tree"].iloc[0]), int(batch["node"].iloc[0]), np.zeros(len(batch), np.int64)
        for number, rows in enumerate(_split(_stack(batch["vec"]), np.arange(len(batch)), leaf_rows, np.random.default_rng([seed, tree, node]))):
            part[rows] = number
        return pd.DataFrame({"id": batch["id"], "tree": tree, "node": node, "part": part})

    return run


def _forest(points: DataFrame, trees: int, leaf_rows: int, seed: int) -> DataFrame:
    """(id, tree, node, part): leaves of at most about ``leaf_rows`` points.

    Every level splits the nodes of more than ``TASK_ROWS`` points, of all trees in one job, by the bisector of two of
    their points, drawn by hash. Smaller nodes are split to leaves in one task each, so the number of levels hardly
    grows. Nodes that no level makes smaller, as copies of one point, are cut by hash.
    """
    kind = points.schema["id"].dataType.simpleString()
    leaf = f"id {kind}, tree int, node long, part long"
    task_rows = max(TASK_ROWS, leaf_rows)
    placed = cut_lineage(points.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).cast("long").alias("node")))
    depth = int(np.ceil(np.log2(max(2.0, points.count() / task_rows)))) * 2 + 4
    done = None
    for level in range(depth):
        sizes = placed.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))
        sized = cut_lineage(placed.join(sizes, ["tree", "node"]))
        small = sized.where(F.col("n") <= task_rows).select("id", "tree", "node")
        done = small if done is None else done.unionByName(small)
        large = sized.where(F.col("n") > task_rows).select("id", "tree", "node")
        if large.isEmpty():
            placed = large
            break
        draw = F.xxhash64("id", "tree", F.lit(seed + level))
        drawn = large.groupBy("tree", "node").agg(F.min_by("id", draw).alias("p_id"), F.max_by("id", draw).alias("q_id"))
        pivots = drawn.join(points.select(F.col("id").alias("p_id"), F.col("vec").alias("p")), "p_id").join(points.select(F.col("id").alias("q_id"), F.col("vec").alias("q")), "q_id")
        placed = cut_lineage(large.join(points, "id").join(cut_lineage(pivots.drop("p_id", "q_id")), ["tree", "node"]).select("id", "tree", "node", "vec", "p", "q").mapInPandas(_sides, f"id {kind}, tree int, node long"))
    left = placed.groupBy("tree", "node").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).alias("parts"))
    rest = placed.join(left, ["tree", "node"]).select("id", "tree", "node", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).alias("part"))
    return cut_lineage(rest.unionByName(done.join(points, "id").groupBy("tree", "node").applyInPandas(_leaves(leaf_rows, seed), leaf)))


def _within(k: int):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        ids, x = batch["id"].to_numpy(), _stack(batch["vec"])
        found = nearest_rows(ids, x, ids, x, k + 1, "l2")
        return found[found["src"] != found["dst"]]

    return run


def _introduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distances inside each circle of points, both ways, where they do not exceed the limit of the first point."""
    for batch in batches:
        found = []
        for ids, limits, flat in zip(batch["ids"], batch["limits"], batch["flat"]):
            x = np.asarray(flat, float).reshape(len(ids), -1)
            d = pair_distances(x, x, "l2")
            np.fill_diagonal(d, np.nan)
            i, j = np.nonzero(d <= np.asarray(limits)[:, None])
            found.append(pd.DataFrame({"src": ids[i], "dst": ids[j], "distance": d[i, j]}))
        if found:
            yield pd.concat(found).drop_duplicates(["src", "dst"])


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The first k of each point, from one shuffle by point; pairs may come more than once."""
    order = W.partitionBy("src").orderBy("distance", "dst")
    once = pairs.repartition("src").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return cut_lineage(once.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k))


def approximate_neighbors(points: DataFrame, k: int, trees: int = 6, leaf_rows: int = 32, rounds: int = 2, friends: int = 10, seed: int = 5, distances: list[int] | None = None) -> DataFrame:
    """About the k nearest other points of every point: ``src``, ``dst``, ``distance``, ``rank``, as ``exact_neighbors``.

    ``points`` has cell_id and vec. Leaves of ``trees`` random trees give the first lists. In each round a point's
    ``friends`` nearest, and as many of those that list it, are introduced to each other: they meet in one task, each with
    its vector, and only pairs that can enter a list leave it. So there are at most n (trees x leaf_rows + rounds x friends (2 friends - 1)) distances.
    Equal distances are ordered by id. ``distances`` gets the numbers that the leaves and the rounds computed.
    """
    rows = cut_lineage(points.select(F.col("cell_id").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec")))
    kind = rows.schema["id"].dataType.simpleString()
    pair = f"src {kind}, dst {kind}, distance double"
    leaves = _forest(rows, trees, leaf_rows, seed)
    lists = _best(leaves.join(rows, "id").groupBy("tree", "node", "part").applyInPandas(_within(k), pair), k)
    if distances is not None:
        sizes = leaves.groupBy("tree", "node", "part").agg(F.count(F.lit(1)).alias("n"))
        distances.append(sizes.agg(F.sum(F.col("n") * F.col("n"))).head()[0] or 0)
    for _ in range(rounds):
        near = lists.where(F.col("rank") <= friends).select("src", "dst", "distance")
        back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")
        back = back.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))).where(F.col("r") <= friends).drop("r")
        circle = cut_lineage(near.unionByName(back).select("src", "dst").distinct())
        full = lists.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.max("distance").alias("m")).where(F.col("c") == k)
        limited = rows.join(full.select(F.col("src").alias("id"), "m"), "id", "left").select(F.col("id").alias("dst"), F.struct("id", F.coalesce("m", F.lit(float("inf"))).alias("limit"), "vec").alias("p"))
        gathered = circle.join(limited, "dst").groupBy("src").agg(F.collect_list("p").alias("l")).select(
            F.col("l.id").alias("ids"), F.col("l.limit").alias("limits"), F.flatten("l.vec").alias("flat")
        )
        if distances is not None:
            sizes = circle.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
            distances.append(sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")).head()[0] or 0)
        lists = _best(lists.drop("rank").unionByName(gathered.mapInPandas(_introduced, pair)), k)
    return lists


def _nearest_of_sample(k: int, ids: np.ndarray, x: np.ndarray, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = nearest_rows(ids, x, batch["id"].to_numpy(), _stack(batch["vec"]), k + 1, "l2")
                yield found[found["src"] != found["dst"]]

    return run


def recall(found: DataFrame, points: DataFrame, k: int, sample: int = 200, seed: int = 9) -> float:
    """Share of the true k nearest neighbours that ``found`` has, over ``sample`` points drawn by hash.

    The sample is compared with every point, a batch at a time in the tasks; ties at the k-th place count as found.
    """
    rows = points.select(F.col("cell_id").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
    if not drawn:
        return 1.0
    ids, x = np.array([r["id"] for r in drawn]), np.array([r["vec"] for r in drawn], dtype=float)
    near = rows.mapInPandas(_nearest_of_sample(k, ids, x, kind), f"src {kind}, dst {kind}, distance double")
    true = near.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))).where(F.col("rank") <= k)
    limit = true.groupBy("src").agg(F.max("distance").alias("limit"), F.count(F.lit(1)).alias("n"))
    hits = found.join(limit, "src").groupBy("src").agg(F.count_if(F.col("distance") <= F.col("limit") * (1 + 1e-9)).alias("hits"))
    one = limit.join(hits, "src", "left").agg(F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")), F.sum("n")).head()
    return float(one[0]) / float(one[1]) if one[1] else 1.0
