"""Exact nearest neighbours inside groups, by bounded blocks of points.

In few dimensions points are cut into blocks of limited size around pivots. Each
block first finds neighbours among its own points, which bounds every point's search
radius; the triangle inequality then tells which other blocks can still hold a closer
point, and only those are compared. In many dimensions nearly all blocks could, so a
point would be sent to each of them; there a group is cut into large parts instead,
and every part of the queries meets every part of the points once. Neither a block nor
a comparison grows with the data, and nothing about the groups is gathered on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from countloom.functions.ranking import draw_key
from countloom.session import cut_lineage

CHUNK_PAIRS = 1_000_000  # pairs of a point and a pivot of its group that meet in one task
TILE, TILED_DIMS = 32, 3  # close points searched together, in so few dimensions that a box leaves out most others
QUERY_ROWS, POINT_ROWS, FEW_PARTS = 50_000, 80_000, 12  # rows of a group that meet in one task, where it has many dimensions
SLICE, TILE_COLUMNS = 500, 2048  # queries and points of one screened product
METRICS = {"euclidean": "l2", "l2": "l2", "cityblock": "l1", "manhattan": "l1", "l1": "l1", "chebyshev": "linf", "linf": "linf", "infinity": "linf"}


def pair_distances(a, b, metric):
    """Distances between the rows of two arrays, in slices of limited memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for s in range(0, len(a), step):
        diff = a[s:s + step, None, :] - b[None, :, :]
        if metric == "l2":
            out[s:s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        elif metric == "l1":
            out[s:s + step] = np.abs(diff).sum(axis=2)
        else:
            out[s:s + step] = np.abs(diff).max(axis=2)
    return out


def _least(d, k):
    """Row, column and value of the k least of every row; ties go to the lower column."""
    k = min(k, d.shape[1])
    if not k:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    last = np.partition(d, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(~(d > last[:, None]))
    order = np.lexsort((col, d[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], d[row[keep], col[keep]]


def _in_tiles(queries, points, k, metric, radius):
    """As ``_least`` of all distances, up to each query's radius: a tile of close queries meets only points of its widened box.

    Without a radius the points are their own queries, and each tile bounds its radius by its own points.
    """
    size = max(TILE, 4 * k)
    strips = max(1, round(np.sqrt(len(queries) / size)))
    by_first = np.empty(len(queries), int)
    by_first[np.argsort(queries[:, 0], kind="stable")] = np.arange(len(queries)) * strips // max(1, len(queries))
    order, found = np.lexsort((queries[:, -1], by_first)), []
    for s in range(0, len(order), size):
        rows = order[s:s + size]
        at = queries[rows]
        if radius is not None:
            bound = radius[rows]
        elif len(at) < k:
            bound = np.full(len(at), np.inf)
        else:
            bound = np.partition(pair_distances(at, at, metric), k - 1, axis=1)[:, k - 1]
        reach = bound.max() * (1 + 1e-9) + 1e-12
        cols = np.flatnonzero(((points >= at.min(axis=0) - reach) & (points <= at.max(axis=0) + reach)).all(axis=1))
        row, col, d = _least(pair_distances(at, points[cols], metric), k)
        near = d <= bound[row] * (1 + 1e-9) + 1e-12
        found.append((rows[row[near]], cols[col[near]], d[near]))
    row, col, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((col, d, row))
    return row[order], col[order], d[order]


def nearest_rows(query_ids, queries, ids, points, k, metric, radius=None):
    """(query, candidate, distance) of the k nearest per query; ties go to the lower id.

    Candidates beyond a query's ``radius`` may be left out.
    """
    own = radius is None and queries is points
    order = np.argsort(ids, kind="stable")
    query_ids, queries = (query_ids[order], queries[order]) if own else (query_ids, queries)
    ids, points = ids[order], points[order]
    if points.shape[1] <= TILED_DIMS and (own or radius is not None) and np.isfinite(points).all() and np.isfinite(queries).all():
        row, col, d = _in_tiles(queries, points, k, metric, radius)
    else:
        row, col, d = _least(pair_distances(queries, points, metric), k)
    return pd.DataFrame({"src": query_ids[row], "dst": ids[col], "distance": d})


def _screened(queries, points, k):
    """As ``_least`` of all Euclidean distances: products in single precision leave out what cannot be among the k least, the rest is measured.

    The score of a point, q.p - p.p / 2, is the higher the closer it is. ``slack`` is more than a score can be wrong by.
    """
    centre, dims = points.mean(axis=0), points.shape[1]
    q, p = queries - centre, points - centre
    pp = np.einsum("ij,ij->i", p, p)
    norms, far = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(pp.max())
    largest = max(np.abs(queries).max(), np.abs(points).max())
    slack = (dims + 8) * 2.0 ** -22 * (norms * far + far * far + 1e-30) + dims * 2.0 ** -48 * largest * (norms + far)
    q32, p32 = np.c_[q, np.ones(len(q))].astype(np.float32), np.c_[p, -pp / 2].astype(np.float32)
    found = []
    for s in range(0, len(q), SLICE):
        at, n = slice(s, s + SLICE), len(q[s:s + SLICE])
        kept = np.empty(0, int), np.empty(0, int), np.empty(0)
        new, waiting, floor = [], 0, np.full(n, -np.inf)
        for t in range(0, len(p), TILE_COLUMNS):
            score = q32[at] @ p32[t:t + TILE_COLUMNS].T
            if t == 0 and score.shape[1] > k:
                floor = np.partition(score, -k, axis=1)[:, -k].astype(float) - 2 * slack[at]
            # rounded down, so that the comparison in single precision leaves out nothing
            row, col = np.divmod(np.flatnonzero(score >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]), score.shape[1])
            new.append((row, col + t))
            waiting += len(row)
            if waiting > 64 * n or t + TILE_COLUMNS >= len(p):
                row, col = (np.concatenate(x) for x in zip(*new))
                d = np.concatenate([_measured(queries[at], points, row[i:i + 65_536], col[i:i + 65_536]) for i in range(0, len(row), 65_536)] or [np.empty(0)])
                row, col, d = (np.concatenate(x) for x in zip(kept, (row, col, d)))
                order = np.lexsort((col, d, row))
                row, col, d = row[order], col[order], d[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                last = place == k - 1
                floor[row[last]] = (norms[at][row[last]] ** 2 - d[last] ** 2) / 2 - slack[at][row[last]]
                kept, new, waiting = (row[place < k], col[place < k], d[place < k]), [], 0
        found.append((kept[0] + s, *kept[1:]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _measured(queries, points, row, col):
    diff = queries[row] - points[col]
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _part_pair(k, metric):
    """The k nearest points of one part of a group for each query of another."""
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        points = points.sort_values("id", kind="stable")
        src, ids, q, p = queries["id"].to_numpy(), points["id"].to_numpy(), _stack(queries["vec"]), _stack(points["vec"])
        if metric == "l2" and max(np.abs(q).max(), np.abs(p).max()) < 1e15:
            row, col, d = _screened(q, p, k)
        else:
            step = max(1, 4_000_000 // len(p))
            parts = [(s, _least(pair_distances(q[s:s + step], p, metric), k)) for s in range(0, len(q), step)]
            row, col, d = (np.concatenate(x) for x in zip(*[(r + s, c, x) for s, (r, c, x) in parts]))
        return pd.DataFrame({"src": src[row], "dst": ids[col], "distance": d})

    return run


def _stack(column):
    return np.vstack(column.to_numpy()).astype(float)


def _local(k, metric):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        ids, vec = batch["id"].to_numpy(), _stack(batch["vec"])
        return nearest_rows(ids, vec, ids, vec, k, metric)

    return run


def _across(k, metric):
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        return nearest_rows(
            queries["id"].to_numpy(), _stack(queries["vec"]), points["id"].to_numpy(), _stack(points["vec"]), k, metric, queries["radius"].to_numpy()
        )

    return run


def _to_pivots(metric):
    """Nearest pivot of each point, and its distance, among the pivots of its group."""
    def run(points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(pivots):
            return pd.DataFrame({"id": [], "grp": [], "vec": [], "home": [], "pivot": [], "pivot_distance": []})
        d = pair_distances(_stack(points["vec"]), _stack(pivots["at"]), metric)
        best = d.argmin(axis=1)
        return points[["id", "grp", "vec", "home"]].assign(pivot=pivots["pivot"].to_numpy()[best], pivot_distance=d[np.arange(len(d)), best])

    return run


def _to_visit(metric, columns):
    """Pivots, other than the home block, whose ball can hold a point closer than the radius known so far."""
    def run(points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(pivots):
            return pd.DataFrame({c: [] for c in columns})
        d = pair_distances(_stack(points["vec"]), _stack(pivots["at"]), metric)
        limit = points["radius"].to_numpy()[:, None] + pivots["reach"].to_numpy()[None, :]
        i, j = np.nonzero(d <= limit * (1 + 1e-9) + 1e-12)
        return points.drop(columns="vec").iloc[i].assign(visit=pivots["pivot"].to_numpy()[j])[columns]

    return run


def exact_neighbors(points: DataFrame, k: int, metric: str = "euclidean", group: str | None = None, block_rows: int = 2000, max_pivots: int = 1024) -> DataFrame:
    """The k nearest other points of every point in its group: ``src``, ``dst``, ``distance``, ``rank``.

    ``points`` has cell_id and vec. Fewer than k are returned only where the
    group has fewer other points. Copies of one location are searched once, and
    only the k + 1 lowest ids of a location can be anybody's neighbour.
    """
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric {metric!r}")
    metric = METRICS[metric]
    grp = F.col(group).cast("string") if group else F.lit("all")
    rows = cut_lineage(points.select("cell_id", grp.alias("grp"), F.transform("vec", lambda x: x.cast("double") + 0.0).alias("vec")))
    homes = rows.groupBy("grp", "vec").agg(F.min("cell_id").alias("home"))
    first = W.partitionBy("grp", "vec").orderBy("cell_id")
    able = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    able = cut_lineage(able.select(F.col("cell_id").alias("id"), "grp", "vec", (F.col("_n") == 1).alias("home")))
    id_type = rows.schema["cell_id"].dataType.simpleString()
    found_schema = f"src {id_type}, dst {id_type}, distance double"
    sizes = able.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"))
    big = cut_lineage(sizes.where(F.col("n") > block_rows))
    small = able.join(big, "grp", "left_anti")
    whole = able.where("home").select(F.col("id").alias("src"))
    near = small.groupBy("grp").applyInPandas(_local(k + 1, metric), found_schema)
    flat, deep = big.where(F.col("dims") <= TILED_DIMS).drop("dims"), big.where(F.col("dims") > TILED_DIMS)
    if not flat.isEmpty():
        near = near.unionByName(_large_groups(able.join(flat, "grp"), k, metric, block_rows, max_pivots, found_schema, id_type))
    if not deep.isEmpty():
        near = near.unionByName(_large_groups_by_parts(able, deep, k, metric, block_rows, found_schema))
    near = cut_lineage(near.join(whole, "src", "left_semi"))
    # every member of a location takes the location's list without itself
    lists = near.withColumnRenamed("src", "home")
    out = rows.join(homes, ["grp", "vec"]).select(F.col("cell_id").alias("src"), "home").join(lists, "home").where(F.col("src") != F.col("dst"))
    best = W.partitionBy("src").orderBy("distance", "dst")
    return out.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("src", "dst", "distance", "rank")


def _large_groups_by_parts(able: DataFrame, big: DataFrame, k: int, metric: str, block_rows: int, found_schema: str) -> DataFrame:
    """Every part of a group's queries meets every part of its points in one task: a point is sent once for each part of the queries."""
    n = F.col("n")
    parts = cut_lineage(big.select(
        "grp", F.greatest(F.ceil(n / QUERY_ROWS), F.least(F.lit(FEW_PARTS), F.ceil(n / block_rows))).alias("asking"), F.ceil(n / POINT_ROWS).alias("offering")
    ))
    # Keys fall on tasks by hash; with four tasks for each most keys have one of their own.
    meetings = parts.agg(F.sum(F.col("asking") * F.col("offering"))).head()[0]
    tasks = max(int(able.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * meetings, 2000))
    rows = able.join(parts, "grp").repartition(tasks, "id")  # dealt out before each becomes a row for every part that it meets

    def sent(df, own, to, tag):
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1))
        keys = {"grp": F.col("grp"), own: F.pmod(F.xxhash64("id", F.lit(5)), F.col(own)), to: every}
        named = [f"{tag}_{c}" for c in ("grp", "asking", "offering")]
        sides = df.select(F.col("id").alias("id"), F.col("vec").alias("vec"), *[keys[c.removeprefix(f"{tag}_")].alias(c) for c in named])
        return sides.repartition(tasks, *named).groupBy(*named)

    met = sent(rows.where("home"), "asking", "offering", "q").cogroup(sent(rows, "offering", "asking", "p")).applyInPandas(_part_pair(k + 1, metric), found_schema)
    best = W.partitionBy("src").orderBy("distance", "dst")
    return met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("src", "dst", "distance")


def _chunks(block_rows: int, max_pivots: int):
    """Into how many chunks the ``n`` points of a group are dealt, so that a chunk's pairs with pivots stay bounded."""
    pivots = F.least(F.lit(max_pivots), F.ceil(F.col("n") / block_rows))
    return F.ceil(F.col("n") * pivots / CHUNK_PAIRS)


def _large_groups(able: DataFrame, k: int, metric: str, block_rows: int, max_pivots: int, found_schema: str, id_type: str) -> DataFrame:
    drawn = W.partitionBy("grp").orderBy("_key", "id")
    want = F.least(F.lit(max_pivots), F.ceil(F.col("n") / block_rows))
    picked = able.where("home").withColumn("_key", draw_key(F.col("id"), 11)).withColumn("_r", F.row_number().over(drawn)).where(
        (F.col("_r") <= max_pivots) & (F.col("_r") <= want)
    )
    # A group's pivots meet its points a chunk of points at a time, so neither the driver nor a task sees all groups' pivots.
    pivots = cut_lineage(picked.select(F.col("grp").alias("of"), F.concat_ws("/", "grp", F.col("_r").cast("string")).alias("pivot"), F.col("vec").alias("at"), _chunks(block_rows, max_pivots).alias("chunks")))
    dealt = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    chunk = F.pmod(F.xxhash64("id", F.lit(3)), _chunks(block_rows, max_pivots)).alias("chunk")
    base = f"id {id_type}, grp string, vec array<double>, home boolean"
    chunked = able.select("id", "grp", "vec", "home", chunk).groupBy("grp", "chunk")
    placed = cut_lineage(chunked.cogroup(dealt.groupBy("of", "chunk")).applyInPandas(_to_pivots(metric), base + ", pivot string, pivot_distance double"))
    balls = placed.groupBy("pivot").agg(F.max("pivot_distance").alias("reach"), F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    balls = cut_lineage(balls)
    reached = dealt.join(balls.select("pivot", "reach"), "pivot")  # a pivot without points needs no visit
    salted = placed.join(balls.select("pivot", "parts"), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    salted = cut_lineage(salted)
    local = cut_lineage(salted.groupBy("pivot", "part").applyInPandas(_local(k + 1, metric), found_schema))
    radius = local.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.max("distance").alias("m")).select(
        F.col("src").alias("id"), F.when(F.col("c") > k, F.col("m")).otherwise(F.lit(float("inf"))).alias("radius")
    )
    searching = salted.where("home").join(radius, "id").select("id", "grp", "vec", "home", F.col("pivot").alias("own"), F.col("part").alias("own_part"), "radius")
    columns = ["id", "own", "own_part", "radius", "visit"]
    sizes = pivots.select(F.col("of").alias("grp"), "chunks").distinct()
    searching = searching.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")))
    visits = searching.drop("chunks").groupBy("grp", "chunk").cogroup(reached.groupBy("of", "chunk")).applyInPandas(
        _to_visit(metric, columns), f"id {id_type}, own string, own_part long, radius double, visit string"
    )
    parts = balls.select(F.col("pivot").alias("visit"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    targets = cut_lineage(visits.join(parts, "visit").where((F.col("visit") != F.col("own")) | (F.col("part") != F.col("own_part"))).select("id", "radius", "visit", "part"))
    loads = targets.groupBy("visit", "part").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("chunks"))
    asked = targets.join(loads, ["visit", "part"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")))
    offered = salted.select("id", "vec", F.col("pivot").alias("visit"), "part").join(loads, ["visit", "part"]).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    )
    keys = ["visit", "part", "chunk"]
    asked = asked.join(salted.select("id", F.col("vec").alias("at")), "id").withColumnRenamed("at", "vec")
    far = asked.select("id", "vec", "radius", *keys).groupBy(*keys).cogroup(offered.select("id", "vec", *keys).groupBy(*keys)).applyInPandas(_across(k + 1, metric), found_schema)
    both = local.unionByName(far)
    best = W.partitionBy("src").orderBy("distance", "dst")
    return both.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("src", "dst", "distance")
