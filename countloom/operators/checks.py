"""Predicates, key checks and aligned subsets. Checks return tables; ``require`` turns one into an error."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Names under which a donor may be recorded, in order of preference.
DONOR_ALIASES = ["donor", "donor_id", "subject_id", "subject", "patient_id", "patient", "mouse_id", "mouse"]
# Level names that mean a control.
CONTROL_LEVELS = [
    "ctrl", "control", "con", "untreated", "unstim", "unstimulated", "baseline", "vehicle", "mock", "wt", "false",
    "0", "normal", "healthy",
]
# Texts that mean a missing identity.
MISSING_WORDS = ["nan", "none", "null", "<na>", "nat"]
# Name rules of columns left over from earlier analyses, on names reduced to a-z and 0-9.
DERIVED_ANYWHERE = [
    "cluster", "annotation", "pseudotime", "leiden", "louvain", "velocity", "snnres", "spatialdomain",
]
DERIVED_PREFIX = [
    "ncount", "nfeature", "totalcounts", "ngenesbycounts", "pctcounts", "percentmito", "sscore", "g2mscore",
    "cellcyclescore", "rootcell", "rootscore", "rootprob", "endcell", "endpoint", "endscore", "endprob",
    "terminalstate", "terminalprob",
]
DERIVED_EXACT = ["qcpassed", "phase", "latenttime", "initialsizespliced", "initialsizeunspliced", "iroot"]
DERIVED_PATTERN = r"(x)?(tsne|umap|pca|diffmap|embedding)([0-9]+|[xyz])?|pc[0-9]+"


def require(check: DataFrame, ok: str, message: str) -> None:
    """Raise with the first failing row of a check table."""
    failed = check.where(~F.coalesce(F.col(ok), F.lit(False))).limit(1).collect()
    if failed:
        raise ValueError(f"{message}: {failed[0].asDict()}")


def count_validity(counts: DataFrame, value: str = "value", layer: str | None = None) -> DataFrame:
    """One pass: how many values are missing, infinite, negative, fractional or too large, per layer."""
    v = F.col(value).cast("double")
    groups = [layer] if layer else []
    out = counts.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_nonfinite"),
        F.count_if(v < 0).alias("n_negative"),
        F.count_if(~F.isnan(v) & (F.abs(v) != float("inf")) & (v != F.floor(v))).alias("n_fractional"),
        F.count_if(v >= F.lit(2.0**63)).alias("n_too_large"),
    )
    bad = F.col("n_nonfinite") + F.col("n_negative") + F.col("n_fractional") + F.col("n_too_large")
    return out.withColumn("valid", bad == 0)


def choose_count_layer(layers: DataFrame, layer: str = "layer", value: str = "value") -> DataFrame:
    """Pick ``counts``, else ``X``, else ``raw``. A present but invalid ``counts`` layer is never replaced."""
    checks = count_validity(layers, value, layer)
    rank = F.when(F.col(layer) == "counts", 1).when(F.col(layer) == "X", 2).when(F.col(layer) == "raw", 3)
    picked = checks.where(rank.isNotNull()).agg(
        F.max(F.when(F.col(layer) == "counts", F.col("valid"))).alias("_named"),
        F.min_by(F.when(F.col("valid"), F.col(layer)), F.when(F.col("valid"), rank)).alias("_best"),
    )
    return picked.select(
        F.when(F.col("_named") == F.lit(False), F.lit(None).cast("string")).otherwise(F.col("_best")).alias("chosen_layer"),
        F.when(F.col("_named") == F.lit(False), F.lit("counts layer is invalid"))
        .when(F.col("_best").isNull(), F.lit("no finite nonnegative integer layer"))
        .otherwise(F.lit("ok")).alias("status"),
    )


def identity_missing(column: Column) -> Column:
    text = F.trim(column.cast("string"))
    return F.coalesce((text == "") | F.lower(text).isin(MISSING_WORDS), F.lit(True))


def identity_completeness(cells: DataFrame, columns: list[str]) -> DataFrame:
    one = cells.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(identity_missing(F.col(c))).alias(f"_{c}") for c in columns]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("n_missing")) for c in columns])
    return one.select("n_rows", F.inline(rows)).select(
        "column", "n_rows", "n_missing", (F.col("n_missing") == 0).alias("complete")
    )


def donor_alias_agreement(cells: DataFrame, aliases: list[str] | None = None) -> DataFrame:
    """Rows on which each further donor column disagrees with the first one present."""
    present = [a for a in (aliases or DONOR_ALIASES) if a in cells.columns]
    if len(present) < 2:
        return cells.sparkSession.createDataFrame([], "selected string, other string, n_disagree long, agree boolean")
    first, *others = present

    def text(c):
        return F.trim(F.col(c).cast("string"))

    one = cells.agg(*[F.count_if(~text(first).eqNullSafe(text(o))).alias(f"_{o}") for o in others])
    rows = F.array(*[F.struct(F.lit(o).alias("other"), F.col(f"_{o}").alias("n_disagree")) for o in others])
    return one.select(F.inline(rows)).select(
        F.lit(first).alias("selected"), "other", "n_disagree", (F.col("n_disagree") == 0).alias("agree")
    )


def split_individuals(cells: DataFrame, explicit: str, biological: str) -> DataFrame:
    """Individuals that an explicit donor column would split into several donors."""
    return cells.where(F.col(biological).isNotNull()).groupBy(biological).agg(
        F.min(explicit).alias("first_identity"), F.max(explicit).alias("last_identity")
    ).where(F.col("first_identity") != F.col("last_identity"))


def resolve_donor_column(cells: DataFrame, explicit: str | None = None) -> str | None:
    """Name of the donor column; raises when an explicit one splits individuals or aliases disagree."""
    present = [a for a in DONOR_ALIASES if a in cells.columns]
    if explicit is not None:
        if explicit not in cells.columns:
            raise ValueError(f"Donor column {explicit!r} is not present")
        for other in present:
            if other != explicit and split_individuals(cells, explicit, other).limit(1).count():
                raise ValueError(f"Donor column {explicit!r} splits individuals of {other!r}")
        return explicit
    if not present:
        return None
    require(donor_alias_agreement(cells), "agree", "Donor columns disagree; name one explicitly")
    return present[0]


def contrast_levels(cells: DataFrame, condition: str = "condition") -> DataFrame:
    """Tested and reference level when exactly two levels exist; one control word decides the reference."""
    levels = cells.where(F.col(condition).isNotNull()).select(F.col(condition).cast("string").alias("level")).distinct()
    control = F.lower(F.trim("level")).isin(CONTROL_LEVELS)
    one = levels.agg(
        F.count(F.lit(1)).alias("n_levels"), F.min("level").alias("_low"), F.max("level").alias("_high"),
        F.count_if(control).alias("_n_control"), F.max(F.when(control, F.col("level"))).alias("_control"),
    )
    reference = F.when(F.col("_n_control") == 1, F.col("_control")).otherwise(F.col("_low"))
    return one.select(
        "n_levels",
        F.when(F.col("n_levels") == 2, F.when(reference == F.col("_low"), F.col("_high")).otherwise(F.col("_low"))).alias("tested"),
        F.when(F.col("n_levels") == 2, reference).alias("reference"),
        F.when(F.col("n_levels") != 2, F.lit("not_two_levels")).when(F.col("_n_control") == 1, F.lit("control_word"))
        .otherwise(F.lit("by_name")).alias("reason"),
    )


def resolve_contrast(cells: DataFrame, condition: str = "condition", pair: tuple[str, str] | None = None) -> tuple[str, str]:
    """(tested, reference) as strings, from an explicit pair or from the two levels observed."""
    if pair is not None:
        a, b = (str(v) for v in pair)
        n = cells.where(F.col(condition).isin(a, b)).agg(F.countDistinct(condition)).first()[0]
        if a == b or n != 2:
            raise ValueError(f"Conditions {a!r} and {b!r} must be two different observed levels")
        return a, b
    row = contrast_levels(cells, condition).first()
    if row["n_levels"] != 2:
        raise ValueError(f"Two conditions are needed, found {row['n_levels']}; name a pair")
    return row["tested"], row["reference"]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def key_quality(df: DataFrame, key: str) -> DataFrame:
    """Rows, empty keys, distinct keys, and whether the key is complete and unique."""
    text = F.trim(F.col(key).cast("string"))
    per_key = df.groupBy(text.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_k").isNull() | (F.col("_k") == ""), F.col("_n"))), F.lit(0)).alias("n_empty"),
        F.count_if(F.col("_k").isNotNull() & (F.col("_k") != "")).alias("n_distinct"),
    ).withColumn("unique", (F.col("n_empty") == 0) & (F.col("n_rows") == F.col("n_distinct")))


def is_derived_column(name: str) -> bool:
    """Does a column name mark the result of an earlier analysis?"""
    compact = re.sub(r"[^a-z0-9]", "", name.lower())
    return (
        any(word in compact for word in DERIVED_ANYWHERE)
        or compact.startswith(tuple(DERIVED_PREFIX))
        or compact in DERIVED_EXACT
        or re.fullmatch(DERIVED_PATTERN, compact) is not None
    )


# Gene-table columns that earlier analyses leave behind, by name and by the start of the name.
DERIVED_GENE_EXACT = ["variance_log1p", "means", "dispersions", "dispersions_norm"]
DERIVED_GENE_COMPACT_PREFIX = "highlyvariable"
DERIVED_GENE_PREFIX = ["velocity_", "fit_"]


def is_derived_gene_column(name: str) -> bool:
    """The same for a column of the gene table."""
    low = name.lower()
    compact = re.sub(r"[^a-z0-9]", "", low)
    return low in DERIVED_GENE_EXACT or compact.startswith(DERIVED_GENE_COMPACT_PREFIX) or low.startswith(tuple(DERIVED_GENE_PREFIX))


def drop_derived_gene_columns(genes: DataFrame) -> DataFrame:
    return genes.select(*[c for c in genes.columns if not is_derived_gene_column(c)])


def drop_derived_columns(cells: DataFrame, keep: list[str] | None = None, labels: list[str] = ()) -> DataFrame:
    """``labels`` names cell-type columns to leave out as well, for a study that does not use the labels it was given."""
    keep = keep or []
    return cells.select(*[c for c in cells.columns if c in keep or not (is_derived_column(c) or c in labels)])


def subset_by_label(cells: DataFrame, label: str, column: str = "cell_type") -> DataFrame:
    """Rows of one label: exact matches, or case-insensitive matches when no exact one exists."""
    exact = F.col(column) == label
    any_exact = cells.agg(F.coalesce(F.max(exact), F.lit(False)).alias("e")).scalar()
    return cells.where(F.when(any_exact, exact).otherwise(F.lower(F.col(column).cast("string")) == label.lower()))


def keep_cells(chosen: DataFrame, tables: dict[str, DataFrame], edges: dict[str, DataFrame] | None = None):
    """Restrict every cell-keyed table, and both ends of every edge table, to the chosen cells."""
    ids = chosen.select("cell_id").distinct()
    out = {name: t.join(ids, "cell_id", "left_semi") for name, t in tables.items()}
    for name, e in (edges or {}).items():
        out[name] = e.join(ids.select(F.col("cell_id").alias("src")), "src", "left_semi").join(
            ids.select(F.col("cell_id").alias("dst")), "dst", "left_semi"
        )
    return out


def keep_genes(chosen: DataFrame, tables: dict[str, DataFrame]):
    """Restrict gene-keyed tables to the chosen genes. Raw-count snapshots are not passed in and stay whole."""
    ids = chosen.select("gene_id").distinct()
    return {name: t.join(ids, "gene_id", "left_semi") for name, t in tables.items()}


def mapping_report(target: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Every target id must occur exactly once in the external table; extra ids are only counted."""
    e = external.groupBy(key).agg(F.count(F.lit(1)).alias("_external"))
    t = target.groupBy(key).agg(F.count(F.lit(1)).alias("_target"))
    return t.join(e, key, "full_outer").agg(
        F.count_if(F.col("_target").isNotNull()).alias("n_target"),
        F.count_if(F.col("_external").isNotNull()).alias("n_external"),
        F.count_if(F.col("_external") > 1).alias("n_duplicate_external"),
        F.count_if(F.col("_external").isNull()).alias("n_missing"),
        F.count_if(F.col("_target").isNull()).alias("n_extra"),
    ).withColumn("valid", (F.col("n_duplicate_external") == 0) & (F.col("n_missing") == 0))


def map_external_counts(external: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    return external.join(cells.select("cell_id"), "cell_id", "left_semi").join(genes.select("gene_id"), "gene_id", "left_semi")


def version_invariants(before: DataFrame, after: DataFrame, labels: list[str], key: str = "cell_id") -> DataFrame:
    """Cell counts of two versions, and per label how many retained cells changed it (null-safe)."""
    a = before.select(key, *[F.col(c).alias(f"_a_{c}") for c in labels], F.lit(True).alias("_in_a"))
    b = after.select(key, *[F.col(c).alias(f"_b_{c}") for c in labels], F.lit(True).alias("_in_b"))
    both = F.col("_in_a") & F.col("_in_b")
    one = a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_in_a")).alias("n_before"), F.count_if(F.col("_in_b")).alias("n_after"),
        F.count_if(F.col("_in_a").isNull()).alias("n_unknown"),
        *[F.count_if(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"_{c}") for c in labels],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"_{c}").alias("n_changed")) for c in labels])
    return one.select("n_before", "n_after", "n_unknown", F.inline(rows)).withColumn(
        "preserved", (F.col("n_changed") == 0) & (F.col("n_unknown") == 0)
    )


def row_stochastic(edges: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Rows of an edge table, and how many have invalid weights or do not sum to one."""
    w = F.col("weight")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    rows = edges.groupBy("src").agg(F.count_if(bad).alias("_bad"), F.sum("weight").alias("_sum"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_bad") > 0).alias("n_invalid_rows"),
        F.count_if(F.coalesce(F.abs(F.col("_sum") - 1) > tolerance, F.lit(True))).alias("n_unnormalised_rows"),
    ).withColumn("valid", (F.col("n_invalid_rows") == 0) & (F.col("n_unnormalised_rows") == 0))
