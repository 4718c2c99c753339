"""Linear contrasts under shared designs whose large factors are absorbed instead of written out as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from countloom.functions.special import t_quantile, t_two_sided
from countloom.operators.graph import components
from countloom.session import cut_lineage

LOCAL_PAIRS = 1_000_000  # level pairs of two factors up to which a task solves a key's effects by itself
EXPLICIT_LEVELS = 20  # a factor with more levels is absorbed, if fewer than two are already
SPAN = 1e-10  # a column that keeps less than this share of its squares is in the span of the others


def _factors(samples: DataFrame, paired: bool, covariates: list[str]):
    """(rows, absorbed factors, explicit columns by name, rows of samples) after checks of missing values."""
    numeric = [c for c in covariates if isinstance(samples.schema[c].dataType, NumericType)]
    named = [c for c in covariates if c not in numeric]
    count = samples.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in [*covariates, *(["donor"] if paired else [])]],
        *[F.countDistinct(F.col(c).cast("string")).alias(f"levels_{c}") for c in named],
    ).head()
    for c in [*(["donor"] if paired else []), *covariates]:
        if count[f"missing_{c}"]:
            raise ValueError(f"Design column {c!r} has missing values")
    absorbed = ["donor"] if paired else []
    for c in sorted(named, key=lambda c: -count[f"levels_{c}"]):
        if count[f"levels_{c}"] > EXPLICIT_LEVELS and len(absorbed) < 2:
            absorbed.append(c)
    columns = {c: F.col(c).cast("double") for c in numeric}
    for c in named:
        if c not in absorbed:
            levels = sorted(r[0] for r in samples.select(F.col(c).cast("string")).distinct().collect())
            columns |= {f"{c}={x}": F.when(F.col(c).cast("string") == x, 1.0).otherwise(0.0) for x in levels[1:]}
    return count["n"], absorbed, columns


def two_way_effects(i: np.ndarray, j: np.ndarray, m: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Effects of two factors that fit given level sums best: level pairs (i, j) with m samples, sums s and t.

    Conjugate gradients on the first factor's equations once the second is eliminated; they are consistent and positive
    semi-definite, so starting from zero ends at one of the solutions, all of which have the same fit.
    """
    n0, n1 = np.bincount(i, m, len(s)), np.bincount(j, m, len(t))
    down = lambda b: np.bincount(i, m * b[j], len(s))
    up = lambda a: np.bincount(j, m * a[i], len(t))
    a, r = np.zeros(len(s)), s - down(t / n1)
    p, size = r.copy(), float(r @ r)
    stop = 1e-26 * max(size, float(s @ s), 1e-300)
    for _ in range(20 * len(s) + 50):
        if size <= stop:
            break
        q = n0 * p - down(up(p) / n1)
        bend = float(p @ q)
        if bend <= 0:
            break
        a += size / bend * p
        r -= size / bend * q
        was, size = size, float(r @ r)
        p = r + size / was * p
    return a, (t - up(a)) / n1


class Absorber:
    """Residuals of long (key, sample, value) tables from the indicators of one or two factors of the samples.

    With one factor, a sample's residual is its value less the factor's mean. With two, the effects are a projection on
    both: samples enter as counts of level pairs, values as sums per key and level. While the pairs are no more than
    ``local_pairs``, they go to all tasks, and a key's effects are solved in one of them by conjugate gradients over its
    sums. Beyond that, alternating projections run over tables of (key, level), all keys in one job a turn.
    """

    def __init__(self, samples: DataFrame, keys: list[str], local_pairs: int = LOCAL_PAIRS):
        """``samples`` has the factors as strings _f0 and perhaps _f1."""
        self.samples, self.two = samples, "_f1" in samples.columns
        self.keys, self.local_pairs = keys, local_pairs
        self.size = [samples.groupBy(f).agg(F.count(F.lit(1)).alias("_n")) for f in (["_f0", "_f1"] if self.two else ["_f0"])]
        self.levels = [s.count() for s in self.size]
        self.cross = cut_lineage(samples.groupBy("_f0", "_f1").agg(F.count(F.lit(1)).alias("_m"))) if self.two else None

    def rank(self) -> int:
        """Dimensions that the factors span, with the constant: levels, less one per component of linked levels."""
        if not self.two:
            return self.levels[0]
        links = self.cross.select(F.concat(F.lit("0"), "_f0").alias("a"), F.concat(F.lit("1"), "_f1").alias("b"))
        return sum(self.levels) - components(links).select("component").distinct().count()

    def effects(self, values: DataFrame, most: int = 2000, tolerance: float = 1e-11) -> list[DataFrame]:
        """[(*keys, _f0, _e0)] or with (*keys, _f1, _e1): sums of these are the fit at a sample, for values (*keys, _f0, _f1, _y)."""
        s0 = values.groupBy(*self.keys, "_f0").agg(F.sum("_y").alias("_s"))
        if not self.two:
            return [s0.join(self.size[0], "_f0").select(*self.keys, "_f0", (F.col("_s") / F.col("_n")).alias("_e0"))]
        if self.cross.count() <= self.local_pairs:
            return self._solved(values)
        s1 = cut_lineage(values.groupBy(*self.keys, "_f1").agg(F.sum("_y").alias("_s")))
        s0 = cut_lineage(s0)
        e0 = cut_lineage(s0.join(self.size[0], "_f0").select(*self.keys, "_f0", (F.col("_s") / F.col("_n")).alias("_e0")))
        e1 = None
        for _ in range(most):
            e1 = self._turn(s1, e0, 1)
            new = self._turn(s0, e1, 0).join(e0.withColumnRenamed("_e0", "_was"), [*self.keys, "_f0"], "left")
            new = cut_lineage(new.withColumn("_was", F.coalesce("_was", F.lit(0.0))))
            moved = new.agg(F.max(F.abs(F.col("_e0") - F.col("_was"))).alias("m"), F.max(F.abs("_e0")).alias("s")).head()
            e0 = new.drop("_was")
            if (moved["m"] or 0.0) <= tolerance * max(1.0, moved["s"] or 0.0):
                return [e0, cut_lineage(self._turn(s1, e0, 1))]
        raise ValueError("The two absorbed factors did not settle")

    def _solved(self, values: DataFrame) -> list[DataFrame]:
        pairs = self.cross.toPandas()
        (first, i), (second, j) = (np.unique(pairs[f].to_numpy(object).astype(str), return_inverse=True) for f in ("_f0", "_f1"))
        m = pairs["_m"].to_numpy(float)
        keys = self.keys

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            s, t = (np.zeros(len(names)) for names in (first, second))
            for side, names, total in ((0, first, s), (1, second, t)):
                own = part[part["_side"] == side]
                total[np.searchsorted(names, own["_level"].to_numpy(object).astype(str))] = own["_s"].to_numpy()
            e0, e1 = two_way_effects(i, j, m, s, t)
            out = pd.DataFrame({"_side": np.repeat([0, 1], [len(e0), len(e1)]), "_level": np.concatenate([first, second]).astype(object), "_e": np.concatenate([e0, e1])})
            for k in keys:
                out[k] = part[k].iloc[0]
            return out[[*keys, "_side", "_level", "_e"]]

        sums = values.groupBy(*keys, "_f0").agg(F.sum("_y").alias("_s")).select(*keys, F.lit(0).alias("_side"), F.col("_f0").alias("_level"), "_s")
        sums = sums.unionByName(values.groupBy(*keys, "_f1").agg(F.sum("_y").alias("_s")).select(*keys, F.lit(1).alias("_side"), F.col("_f1").alias("_level"), "_s"))
        kinds = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
        found = cut_lineage(sums.groupBy(*keys).applyInPandas(solve, f"{kinds}, _side int, _level string, _e double"))
        return [found.where(F.col("_side") == side).select(*keys, F.col("_level").alias(f"_f{side}"), F.col("_e").alias(f"_e{side}")) for side in (0, 1)]

    def _turn(self, sums: DataFrame, other: DataFrame, side: int) -> DataFrame:
        own, far = f"_f{side}", f"_f{1 - side}"
        taken = other.join(self.cross, far).groupBy(*self.keys, own).agg(F.sum(F.col(f"_e{1 - side}") * F.col("_m")).alias("_t"))
        rest = taken.join(sums, [*self.keys, own], "left").join(self.size[side], own)
        return rest.select(*self.keys, own, ((F.coalesce("_s", F.lit(0.0)) - F.col("_t")) / F.col("_n")).alias(f"_e{side}"))

    def fitted_squares(self, values: DataFrame) -> DataFrame:
        """(*keys, _p): squared length of the fit, the sum over factors of effects times sums."""
        parts = []
        for side, e in enumerate(self.effects(values)):
            s = values.groupBy(*self.keys, f"_f{side}").agg(F.sum("_y").alias("_s"))
            parts.append(s.join(e, [*self.keys, f"_f{side}"]).select(*self.keys, (F.col("_s") * F.col(f"_e{side}")).alias("_p")))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy(*self.keys).agg(F.sum("_p").alias("_p"))


def _dot(row, weights) -> F.Column:
    return F.aggregate(F.zip_with(row, F.array(*[F.lit(float(x)) for x in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def ols_contrast(samples: DataFrame, values: DataFrame, features: DataFrame, tested: str, paired=False, covariates: list[str] = (), key="gene_id", value="y", alpha: float = 0.05) -> DataFrame:
    """Adjusted condition effect of every feature under one shared linear design.

    ``samples`` has one row per donor and condition, with its covariates. The design is an intercept, the condition
    (1 for ``tested``), donors when ``paired`` and the covariates. Donors, and the largest covariate with over 20
    levels (the two largest if not paired), are absorbed: by the partialling-out theorem the effect and the residual
    are those of what the factors leave. So the driver sees only one small matrix over the few explicit columns, and any
    number of donors and samples is fine. Values are sparse: samples without a row for a feature count as zero.

    Per feature: effect, se, residual_df, interval, statistic, p_value, status. Missing design values, a deficient rank
    and a design without residual degrees of freedom raise. Runs jobs when called.
    """
    covariates = list(covariates)
    own = cut_lineage(samples.select("donor", "condition", *covariates))
    n, absorbed, columns = _factors(own, paired, covariates)
    names = ["condition", *columns]
    x = F.array(F.when(F.col("condition") == tested, 1.0).otherwise(0.0), *columns.values())
    factors = [F.col(c).cast("string").alias(f"_f{i}") for i, c in enumerate(absorbed)] or [F.lit("").alias("_f0")]
    rows = cut_lineage(own.select("donor", "condition", *factors, x.alias("_x")))
    absorber = Absorber(rows, ["_c"] if len(absorbed) == 2 else [])
    p = len(names)
    if len(absorbed) == 2:
        long = rows.select("donor", "condition", "_f0", "_f1", F.posexplode("_x").alias("_c", "_y"))
        e0, e1 = absorber.effects(long)
        left = long.join(e0, ["_c", "_f0"], "left").join(e1, ["_c", "_f1"], "left")
        left = left.select("donor", "condition", "_f0", "_f1", "_c", "_y", (F.col("_y") - F.coalesce("_e0", F.lit(0.0)) - F.coalesce("_e1", F.lit(0.0))).alias("_r"))
        pack = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("_c", c))), lambda z: z[c])
        rows = left.groupBy("donor", "condition", "_f0", "_f1").agg(pack("_y").alias("_x"), pack("_r").alias("_r"))
    else:
        means = rows.groupBy("_f0").agg(F.array(*[F.avg(F.col("_x")[j]) for j in range(p)]).alias("_mean"))
        rows = rows.join(means, "_f0").withColumn("_r", F.zip_with("_x", "_mean", lambda a, b: a - b))
    rows = cut_lineage(rows.select("donor", "condition", *[f"_f{i}" for i in range(len(factors))], "_x", "_r"))
    at = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = rows.agg(*[F.sum(F.col("_r")[i] * F.col("_r")[j]) for i, j in at], *[F.sum(F.col("_x")[i] ** 2) for i in range(p)]).head()
    gram = np.zeros((p, p))
    for (i, j), s in zip(at, sums):
        gram[i, j] = gram[j, i] = s or 0.0
    scale = np.sqrt(np.maximum(np.array([s or 0.0 for s in sums[len(at) :]]), 1e-300))
    rank = int((np.linalg.eigvalsh(gram / np.outer(scale, scale)) > SPAN).sum())
    spanned = absorber.rank()
    if rank < p:
        raise ValueError(f"Design is rank deficient: rank {spanned + rank} of {spanned + p} columns {['intercept', *absorbed, *names]}")
    if n <= spanned + p:
        raise ValueError(f"Design has no residual degrees of freedom: {n} samples, rank {spanned + p}")
    dof = n - spanned - p
    inverse = np.linalg.inv(gram)
    turn = np.linalg.inv(np.linalg.cholesky(gram))  # rows times its transpose are orthonormal columns
    design = rows.select("donor", "condition", *[f"_f{i}" for i in range(len(factors))], _dot("_r", inverse[0]).alias("_w"), *[_dot("_r", turn[j]).alias(f"_q{j}") for j in range(p)])
    met = values.select("donor", "condition", key, F.col(value).alias("_y")).join(design, ["donor", "condition"])
    y = F.col("_y")
    wanted = {"_effect": F.col("_w") * y, "_square": y * y} | {f"_q{j}": F.col(f"_q{j}") * y for j in range(p)}
    if len(absorbed) == 2:
        met = cut_lineage(met)
        fit = met.groupBy(key).agg(*[F.sum(c).alias(k) for k, c in wanted.items()])
        absorber.keys = [key]
        fit = fit.join(absorber.fitted_squares(met), key, "left")
    else:
        per = met.groupBy(key, "_f0").agg(F.sum(y).alias("_y"), *[F.sum(c).alias(k) for k, c in wanted.items()])
        fit = per.join(absorber.size[0], "_f0").groupBy(key).agg(F.sum(F.col("_y") * F.col("_y") / F.col("_n")).alias("_p"), *[F.sum(k).alias(k) for k in wanted])
    explained = F.col("_p") + sum((F.col(f"_q{j}") * F.col(f"_q{j}") for j in range(p)), F.lit(0.0))
    rss = F.when(F.col("_square") - explained > 1e-12 * F.col("_square"), F.col("_square") - explained).otherwise(F.lit(0.0))
    se = F.sqrt(F.coalesce(rss, F.lit(0.0)) / dof * float(inverse[0, 0]))
    out = features.select(key).join(fit, key, "left").select(key, F.coalesce("_effect", F.lit(0.0)).alias("effect"), se.alias("se"), F.lit(dof).cast("long").alias("residual_df"))
    crit = t_quantile(1 - alpha / 2, dof)
    out = out.withColumns({
        "ci_low": F.col("effect") - crit * F.col("se"), "ci_high": F.col("effect") + crit * F.col("se"),
        "statistic": F.when(F.col("se") > 0, F.col("effect") / F.col("se")),
    }).withColumn("p_value", t_two_sided("statistic", F.col("residual_df").cast("double")))
    return out.withColumn("status", F.when(F.col("p_value").isNotNull(), "estimated").otherwise("not_estimated"))
