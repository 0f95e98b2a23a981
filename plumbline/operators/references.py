"""Direct references of projects: which are packages, how many of each kind, and what a comparison says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.metrics import is_bcl


def package_references(references: DataFrame, projects: DataFrame) -> DataFrame:
    """The references ``snapshot_id, project, ref`` whose target is no listed project of the snapshot, each once.

    Names are compared exactly. A reference that differs from another only in case is one of its own.
    """
    listed = projects.where("project_name is not null").select("snapshot_id", F.col("project_name").alias("ref")).distinct()
    return references.select("snapshot_id", "project", "ref").where("trim(ref) != ''").distinct().join(listed, ["snapshot_id", "ref"], "left_anti").select("snapshot_id", "project", "ref")


def package_counts(references: DataFrame) -> DataFrame:
    """``snapshot_id, n, ed, edb, edp``: package references of each project in all, of the framework and of others.

    ``references`` has ``snapshot_id, project, ref``, each reference of a project once, as ``project_items`` and
    ``package_references`` give them.
    """
    per = references.groupBy("snapshot_id", F.col("project").alias("n")).agg(F.count("ref").alias("ed"), F.count_if(is_bcl("ref")).alias("edb"))
    return per.withColumn("edp", F.col("ed") - F.col("edb"))


def present_projects(projects: DataFrame, references: DataFrame) -> DataFrame:
    """``snapshot_id, key``: the projects of a snapshot, listed or with references, by name without regard to case."""
    listed = projects.where("project_name is not null").select("snapshot_id", F.lower("project_name").alias("key"))
    return listed.unionByName(references.select("snapshot_id", F.lower("project").alias("key"))).distinct()


def of_both_snapshots(changes: DataFrame, present: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``changes`` (``head_snapshot_id, project, ...``) of projects that are neither added nor removed."""
    at = present.withColumnRenamed("snapshot_id", "_s")
    own = changes.withColumn("key", F.lower("project")).join(pairs, "head_snapshot_id")
    for side in ("base", "head"):
        own = own.join(at.select(F.col("_s").alias(f"{side}_snapshot_id"), "key"), [f"{side}_snapshot_id", "key"], "left_semi")
    return own.select(*changes.columns)


def external_changes(packages: DataFrame, pairs: DataFrame) -> DataFrame:
    """``head_snapshot_id, project, ref, outcome, is_bcl``: packages that one snapshot of a pair holds for a project.

    Packages are compared with regard to case, projects without; the shown name of a project is the first in binary order.
    """
    own = packages.select("snapshot_id", F.lower("project").alias("key"), "project", "ref")
    sides = [own.join(pairs, F.col("snapshot_id") == F.col(f"{side}_snapshot_id")).select("head_snapshot_id", "key", "project", "ref", F.lit(sign).alias("sign")) for side, sign in (("head", 1), ("base", -1))]
    once = sides[0].unionByName(sides[1]).groupBy("head_snapshot_id", "key", "ref", "sign").agg(F.min("project").alias("project"))
    net = once.groupBy("head_snapshot_id", "key", "ref").agg(F.min("project").alias("project"), F.sum("sign").alias("net")).where("net != 0")
    return net.select("head_snapshot_id", "project", "ref", F.when(F.col("net") > 0, "added").otherwise("removed").alias("outcome"), is_bcl("ref").alias("is_bcl"))


def added_totals(added: DataFrame) -> DataFrame:
    """Per pair: projects with added references, how many were added, and how many distinct ones without regard to case."""
    return added.groupBy("head_snapshot_id").agg(
        F.count_distinct(F.lower("project")).alias("projects"), F.count(F.lit(1)).alias("total_added"), F.count_distinct(F.lower("ref")).alias("unique_added"), F.count_if(is_bcl("ref")).alias("framework_added")
    )
