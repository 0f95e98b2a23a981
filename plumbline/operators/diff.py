"""Comparison of two snapshots: projects, totals, references and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.metrics import is_bcl, round_even
from plumbline.operators.rollup import EXACT

#: Measures of a project that are compared.
PROJECT_MEASURES = ["type_count", "method_count", "total_cc", "total_loc", "max_dit", "error_count", "warning_count"]
#: Those of the index, the coupling and the packages, with the digits of their deltas.
FURTHER_MEASURES = {"mi": 1, "id": 0, "idx": 0, "dr": 2, "ed": 0, "edb": 0, "edp": 0}


def _sides(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = rows.join(pairs, F.col("snapshot_id") == F.col("base_snapshot_id")).drop("snapshot_id", "base_snapshot_id")
    head = rows.join(pairs, F.col("snapshot_id") == F.col("head_snapshot_id")).drop("snapshot_id", "base_snapshot_id")
    return base, head


def project_diff(projects: DataFrame, pairs: DataFrame, further: dict[str, int] | None = None) -> DataFrame:
    """Full outer join of the projects of each pair by name without regard to case, with deltas.

    The missing side reads as zeros. The shown name is the head's, else the base's. ``further`` measures are
    compared too, by their names with the digits to which their deltas are rounded.
    """
    further = further or {}
    measures = [*PROJECT_MEASURES, *further]
    kind = {m: "double" if further.get(m) else "bigint" for m in measures}
    key = F.lower("project_name")
    own = projects.where("project_name is not null").select("snapshot_id", key.alias("key"), "project_name", *[F.coalesce(F.col(m).cast(kind[m]), F.lit(0).cast(kind[m])).alias(m) for m in measures])
    base, head = _sides(own, pairs)
    base = base.select("head_snapshot_id", "key", F.struct("project_name", *measures).alias("b"))
    head = head.select("head_snapshot_id", "key", F.struct("project_name", *measures).alias("h"))
    side = lambda s, m: F.coalesce(F.col(f"{s}.{m}"), F.lit(0).cast(kind[m]))
    delta = lambda m: round_even(side("h", m) - side("b", m), further[m]) if further.get(m) else side("h", m) - side("b", m)
    columns = [c for m in measures for c in (side("b", m).alias(f"base_{m}"), side("h", m).alias(f"head_{m}"), delta(m).alias(f"{m}_delta"))]
    return base.join(head, ["head_snapshot_id", "key"], "full_outer").select(
        "head_snapshot_id", F.coalesce("h.project_name", "b.project_name").alias("project"), F.col("b").isNull().alias("is_added"), F.col("h").isNull().alias("is_removed"), *columns
    )


def changed_projects(diffs: DataFrame) -> DataFrame:
    """Projects of both snapshots in which the maintainability index, complexity, lines or warnings differ."""
    differs = F.lit(False)
    for m in ("mi", "total_cc", "total_loc", "warning_count"):
        differs = differs | (F.col(f"{m}_delta") != 0)
    return diffs.where(~F.col("is_added") & ~F.col("is_removed") & differs)


#: What is summed up of a snapshot; the average index is rounded to one digit.
TOTALS = ["projects", "types", "methods", "cc", "loc", "errors", "warnings", "info", "hidden_n", "avg_mi"]


def snapshot_totals(projects: DataFrame, methods: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``snapshot_id`` and ``TOTALS`` of every snapshot that has any rows; what it lacks is 0."""
    sums = projects.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("projects"), *[F.coalesce(F.sum(c).cast("bigint"), F.lit(0)).alias(n) for c, n in (("type_count", "types"), ("method_count", "methods"), ("total_cc", "cc"), ("total_loc", "loc"))])
    found = diagnostics.groupBy("snapshot_id").agg(*[F.count_if(F.col("severity") == k).alias(n) for k, n in enumerate(("hidden_n", "info", "warnings", "errors"))])
    return sums.join(found, "snapshot_id", "full_outer").join(average_maintainability(methods), "snapshot_id", "full_outer").na.fill(0).select("snapshot_id", *TOTALS)


def totals_diff(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Totals of both snapshots of each pair and their deltas; snapshots without rows read as zeros."""
    out = pairs
    for side in ("base", "head"):
        own = totals.select(F.col("snapshot_id").alias(f"{side}_snapshot_id"), *[F.col(n).alias(f"{side}_{n}") for n in TOTALS])
        out = out.join(own, f"{side}_snapshot_id", "left")
    out = out.na.fill(0)
    delta = lambda n: round_even(F.col(f"head_{n}") - F.col(f"base_{n}"), 1) if n == "avg_mi" else F.col(f"head_{n}") - F.col(f"base_{n}")
    return out.select("head_snapshot_id", "base_snapshot_id", *[c for n in TOTALS for c in (F.col(f"base_{n}"), F.col(f"head_{n}"), delta(n).alias(f"{n}_delta"))])


def reference_changes(refs: DataFrame, pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Names that only one snapshot of a pair holds: ``head_snapshot_id, by, ref, outcome``.

    ``refs`` has ``snapshot_id``, the columns ``by`` and ``ref``. Names that differ only in case are one
    within a snapshot (the first in binary order stands for them), but snapshots are compared with regard
    to case, so a change of case is both removed and added.
    """
    by = by or []
    own = refs.where("trim(ref) != ''").groupBy("snapshot_id", *by, F.lower("ref").alias("_k")).agg(F.min("ref").alias("ref")).drop("_k")
    base, head = _sides(own, pairs)
    signed = head.withColumn("sign", F.lit(1)).unionByName(base.withColumn("sign", F.lit(-1)))
    net = signed.groupBy("head_snapshot_id", *by, "ref").agg(F.sum("sign").alias("net")).where("net != 0")
    return net.select("head_snapshot_id", *by, "ref", F.when(F.col("net") > 0, "added").otherwise("removed").alias("outcome"))


def reference_summary(changes: DataFrame, new_to_solution: DataFrame) -> DataFrame:
    """Per project the added references as lists of framework and package names, with counts.

    A name that is new to the whole solution is marked. Lists are sorted in binary order.
    """
    fresh = new_to_solution.where("outcome = 'added'").select("head_snapshot_id", F.lower("ref").alias("_k")).distinct()
    added = changes.where("outcome = 'added'").withColumn("_k", F.lower("ref"))
    marked = added.join(fresh.withColumn("is_new", F.lit(True)), ["head_snapshot_id", "_k"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    shown = F.concat(F.lit("`"), F.replace("ref", F.lit("|"), F.lit("\\|")), F.lit("`"), F.when(F.col("is_new"), " 🆕").otherwise(""))
    own = [c for c in changes.columns if c not in ("ref", "outcome")]
    lists = marked.groupBy(*own).agg(
        F.count_if(is_bcl("ref")).alias("bcl_added"),
        F.count_if(~is_bcl("ref")).alias("packages_added"),
        F.count_if("is_new").alias("new_to_solution"),
        F.array_sort(F.collect_list(F.struct("ref", shown.alias("shown")))).alias("refs"),
    )
    return lists.withColumn("summary", first_three(F.transform("refs", lambda r: r["shown"]))).drop("refs")


def first_three(names: Column, most: int = 3) -> Column:
    """The first names of a list and how many more there are; ``none`` for an empty one."""
    rest = F.size(names) - most
    shown = F.when(rest > 0, F.concat(F.slice(names, 1, most), F.array(F.concat(F.lit("+"), rest.cast("string"), F.lit(" more"))))).otherwise(names)
    return F.when(F.size(names) == 0, "none").otherwise(F.array_join(shown, ", "))


def diagnostic_counts(changes: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Added, removed and changed diagnostics of each pair by severity.

    ``changes`` has ``pair, base_key, head_key, outcome``; the severity is that of the row that remains, or
    of the removed one, which needs the base snapshot as ``base_snapshot_id``.
    """
    at = F.when(F.col("outcome") == "removed", F.col("base_snapshot_id")).otherwise(F.col("pair"))
    key = F.when(F.col("outcome") == "removed", F.col("base_key")).otherwise(F.col("head_key"))
    own = diagnostics.select(F.col("snapshot_id").alias("_s"), F.col("pos").alias("_p"), "severity")
    joined = changes.withColumn("_at", at).withColumn("_key", key).join(own, (F.col("_at") == F.col("_s")) & (F.col("_key") == F.col("_p")))
    counts = [F.count_if((F.col("outcome") == o) & (F.col("severity") == s)).alias(f"{o}_{n}") for o in ("added", "removed", "changed") for s, n in enumerate(("hidden", "info", "warning", "error"))]
    return joined.groupBy(F.col("pair").alias("head_snapshot_id")).agg(*counts)


def average_maintainability(methods: DataFrame) -> DataFrame:
    """The mean index of a snapshot's methods, summed in fixed point and rounded to one digit; 0 where there is none."""
    mean = F.sum(F.col("maintainability_index").cast(EXACT)).cast("double") / F.nullif(F.count("maintainability_index"), F.lit(0))
    return methods.groupBy("snapshot_id").agg(F.coalesce(round_even(mean, 1), F.lit(0.0)).alias("avg_mi"))


def diff_metadata(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """What is shown of both snapshots of each pair, and whether both have measures of their methods."""
    out = pairs
    for side in ("base", "head"):
        out = out.join(snapshots.select(F.col("snapshot_id").alias(f"{side}_snapshot_id"), *[F.col(c).alias(f"{side}_{c}") for c in METADATA]), f"{side}_snapshot_id", "left")
    full = lambda side: F.coalesce(F.lower(f"{side}_analysis_mode") == "full", F.lit(False))
    return out.select("head_snapshot_id", "base_snapshot_id", *[f"{side}_{c}" for side in ("base", "head") for c in METADATA], (full("base") & full("head")).alias("has_complexity"))


#: Columns of a snapshot that a comparison names.
METADATA = ["solution_path", "analyzed_at", "commit_sha", "branch_name", "analysis_mode"]


def compare(metadata: DataFrame, totals: DataFrame, projects: DataFrame, diagnostics: DataFrame, presence: DataFrame) -> DataFrame:
    """One row per pair: metadata, totals, and counts of what ``projects``, ``diagnostics`` and ``presence`` say in detail.

    The details stay tables of their own, as a pair may have any number of them: ``project_diff``, ``diagnostic_counts``
    and the ``reference_changes`` of whole snapshots. A pair without any reads as zeros.
    """
    per = projects.groupBy("head_snapshot_id").agg(F.count_if("is_added").alias("projects_added"), F.count_if("is_removed").alias("projects_removed"))
    changed = changed_projects(projects).groupBy("head_snapshot_id").agg(F.count(F.lit(1)).alias("projects_changed"))
    names = presence.groupBy("head_snapshot_id").agg(F.count_if(F.col("outcome") == "added").alias("new_to_solution"), F.count_if(F.col("outcome") == "removed").alias("removed_from_solution"))
    out = metadata.join(totals.drop("base_snapshot_id"), "head_snapshot_id", "left")
    for part in (per, changed, names, diagnostics):
        out = out.join(part, "head_snapshot_id", "left")
    counts = [c for part in (per, changed, names, diagnostics) for c in part.columns if c != "head_snapshot_id"]
    return out.na.fill(0, counts)
