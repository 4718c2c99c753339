"""One-to-one matching of greatest total weight, component by component, with a distributed auction for large ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from countloom.functions.ranking import ordered_positions
from countloom.operators.graph import components
from countloom.session import cut_lineage

LOCAL_LABELS = 2_000  # labels of a side up to which one task solves a component
SCALE = 1_000_000  # weights are matched as whole millionths by the auction


def assign(batch: pd.DataFrame) -> pd.DataFrame:
    """The pairs (a, b) of the matching of greatest total weight in one table (shortest augmenting paths).

    Pairs that are not in the table weigh nothing and are not returned.
    """
    a, ia = np.unique(batch["a"].to_numpy(object).astype(str), return_inverse=True)
    b, ib = np.unique(batch["b"].to_numpy(object).astype(str), return_inverse=True)
    score = np.zeros((len(a), len(b)))
    score[ia, ib] = batch["weight"].to_numpy()
    turned = len(a) > len(b)
    cost = -(score.T if turned else score)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        best, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[at]:
            done[at] = True
            free = ~done
            free[0] = False
            reduced = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = free[1:] & (reduced < best[1:])
            best[1:][better] = reduced[better]
            back[1:][better] = at
            left = np.flatnonzero(free)
            nxt = left[np.argmin(best[left])]
            step = best[nxt]
            u[owner[done]] += step
            v[done] -= step
            best[~done] -= step
            at = nxt
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    pairs = [(j, i) if turned else (i, j) for i, j in pairs]
    pairs = [(i, j) for i, j in pairs if score[i, j] > 0]
    return pd.DataFrame({"a": [a[i] for i, _ in pairs], "b": [b[j] for _, j in pairs]}, columns=["a", "b"])


def auction(pairs: DataFrame, scale: int = SCALE, shrink: int = 5) -> DataFrame:
    """(a, b) of the matching of greatest total weight among ``pairs`` (a, b, weight > 0), weights in whole 1/scale.

    Prices are a table. In each round every bidder without an object offers for its best one what makes it worth as much
    as the second best, and a little more; the highest offer takes the object. The little more shrinks from phase to
    phase, prices stay, and at its end it is too small to matter for whole weights, so the result is exact. To allow
    labels without a partner, each label has a stand-in on the other side that costs nothing, and stand-ins of a pair's
    labels may take each other; so bidders and objects are as many, and all find one. Each round is a job over
    bidders without objects; no list of labels is gathered.
    """
    rows = cut_lineage(pairs.select("a", "b", F.round(F.col("weight") * scale).cast("long").alias("w")))
    side = lambda s, c: F.concat(F.lit(s), F.col(c))
    nothing = F.lit(0).cast("long").alias("w")
    edges = rows.select(side("a", "a").alias("p"), side("b", "b").alias("o"), "w").unionByName(rows.select(side("b", "b").alias("p"), side("a", "a").alias("o"), nothing))
    own = rows.select(F.explode(F.array(side("a", "a"), side("b", "b"))).alias("p")).distinct().select("p", F.col("p").alias("o"), nothing)
    edges = edges.unionByName(own)
    # A label's stand-in has its name: as a bidder, a label of side b is a stand-in, as an object one of side a.
    n = own.count()
    edges = cut_lineage(edges.withColumn("w", F.col("w") * (n + 1)))
    top = edges.agg(F.max("w")).head()[0] or 0
    objects = cut_lineage(edges.select("o").distinct().select("o", F.lit(0).cast("long").alias("price"), F.lit(None).cast("string").alias("owner")))
    more = max(1, top // shrink)
    while True:
        objects = cut_lineage(objects.withColumn("owner", F.lit(None).cast("string")))
        while objects.where("owner IS NULL").count():
            taken = objects.where("owner IS NOT NULL").select(F.col("owner").alias("p"))
            offers = edges.join(taken, "p", "left_anti").join(objects.select("o", "price"), "o").withColumn("net", F.col("w") - F.col("price"))
            two = offers.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy(F.desc("net"), "o"))).where("r <= 2")
            one = two.groupBy("p").agg(F.max_by(F.struct("o", "w", "net"), -F.col("r")).alias("x"), F.min("net").alias("second"), F.count(F.lit(1)).alias("c"))
            second = F.when(F.col("c") > 1, F.col("second")).otherwise(F.col("x.net") - top - more)
            bids = one.select("p", F.col("x.o").alias("o"), (F.col("x.w") - second + more).alias("bid"))
            won = bids.groupBy("o").agg(F.max(F.struct("bid", "p")).alias("won"))
            objects = cut_lineage(objects.join(won, "o", "left").select("o", F.coalesce("won.bid", "price").alias("price"), F.coalesce("won.p", "owner").alias("owner")))
        if more == 1:
            break
        more = max(1, more // shrink)
    kept = objects.where(F.col("owner").startswith("a") & F.col("o").startswith("b"))
    return kept.select(F.expr("substring(owner, 2)").alias("a"), F.expr("substring(o, 2)").alias("b"))


def best_matching(pairs: DataFrame, local_labels: int = LOCAL_LABELS) -> DataFrame:
    """(a, b) of a matching of greatest total weight among ``pairs`` (a, b, weight > 0), strings, each pair once.

    Labels that no chain of pairs connects do not matter to each other: each component is solved by itself, in one task
    when it has at most ``local_labels`` labels on its smaller side and ten times as many on the other, else by auction.
    """
    rows = cut_lineage(pairs.select("a", "b", "weight"))
    found = components(rows.select(F.concat(F.lit("0"), "a").alias("a"), F.concat(F.lit("1"), "b").alias("b")))
    placed = cut_lineage(rows.join(found.select(F.expr("substring(node, 2)").alias("a"), "component").where(F.col("node").startswith("0")), "a"))
    sizes = placed.groupBy("component").agg(F.countDistinct("a").alias("n"), F.countDistinct("b").alias("m"))
    large = cut_lineage(sizes.where((F.least("n", "m") > local_labels) | (F.greatest("n", "m") > 10 * local_labels)).select("component"))
    out = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(assign, "a string, b string")
    if large.isEmpty():
        return cut_lineage(out)
    return cut_lineage(out.unionByName(auction(placed.join(large, "component", "left_semi"))))


def pair_up(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b): the labels of both tables in order, the n-th with the n-th, as far as both go."""
    a, b = (ordered_positions(d, c).select(c, F.col("n_below").alias("_at")) for d, c in ((first, "a"), (second, "b")))
    return a.join(b, "_at").select("a", "b")
