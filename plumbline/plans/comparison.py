"""One comparison of two snapshots, put together from the operators for the renderers of ``sources.reports``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import coupling, diff, references, rollup, snapshot_diff
from plumbline.operators.snapshot_pairs import snapshot_roles
from plumbline.session import durable
from plumbline.sources.model import Model
from plumbline.sources.reports import project_measures

#: Severity of a count of changes, and the name of the total that it belongs to.
_COUNTED = {"error": "errors", "warning": "warnings", "info": "info"}


def _items(changes: DataFrame, diagnostics: DataFrame, outcome: str, key: str, snapshot: str) -> list[dict]:
    own = changes.where(F.col("outcome") == outcome).select(F.col(key).alias("pos"))
    at = diagnostics.where(F.col("snapshot_id") == snapshot).select("pos", "severity", "id", "message", "file", "line", "col_no")
    return [r.asDict() for r in own.join(at, "pos").orderBy("pos").na.fill(0, ["severity"]).collect()]


def comparison_of(m: Model, base: str, head: str) -> dict:
    """The arguments of ``render_diff`` for one pair of snapshots; what comes to the driver is what its report shows.

    Only rows of the two snapshots are read. Projects are in the order of their names without regard to case.
    """
    spark = m.spark
    pairs = spark.createDataFrame([(head, base)], "head_snapshot_id string, base_snapshot_id string")
    of = lambda df: df.where(F.col("snapshot_id").isin(base, head))
    edges, projects, methods, diagnostics = coupling.aggregated(of(m.edges())), durable(of(m.projects())), of(m.methods()), durable(of(m.diagnostics()))
    refs = edges.where("dep_type = 0").select("snapshot_id", F.col("from_entity").alias("project"), F.col("to_entity").alias("ref"))
    packages = durable(references.package_references(refs, projects))
    present = references.present_projects(projects, refs)

    meta = diff.diff_metadata(of(m.snapshots()), pairs).first().asDict()
    totals = diff.totals_diff(diff.snapshot_totals(projects, methods, diagnostics), pairs).first().asDict()
    changes = durable(snapshot_diff.diagnostic_changes(diagnostics, snapshot_roles(pairs)))
    counts = diff.diagnostic_counts(changes.join(pairs.withColumnRenamed("head_snapshot_id", "pair"), "pair"), diagnostics).first()
    wide = project_measures(projects, coupling.project_coupling(edges, projects), rollup.project_rollup(rollup.type_rollup(of(m.types()), methods)), packages)
    rows = diff.project_diff(durable(wide), pairs, diff.FURTHER_MEASURES).orderBy(F.lower("project"), "project").collect()

    kept = lambda df: references.of_both_snapshots(df.where("outcome = 'added'"), present, pairs)
    own = diff.reference_changes(refs.join(packages, ["snapshot_id", "project", "ref"], "left_anti"), pairs, ["project"])
    added = kept(own).groupBy("project").agg(F.array_sort(F.collect_list("ref")).alias("added")).orderBy(F.lower("project"), "project").collect()
    listed = lambda framework: F.array_sort(F.collect_list(F.when(F.col("is_bcl") == framework, F.col("ref"))))
    external = kept(references.external_changes(packages, pairs)).groupBy("project").agg(listed(True).alias("bcl"), listed(False).alias("packages")).orderBy(F.lower("project"), "project").collect()
    fresh = diff.reference_changes(refs.drop("project"), pairs).where("outcome = 'added'").orderBy("ref").collect()
    side = lambda s: {c: meta[f"{s}_{c}"] for c in diff.METADATA}
    return {
        "base": side("base"),
        "head": side("head"),
        "totals": totals,
        "diagnostics": {f"{o}_{n}": counts[f"{o}_{x}"] if counts else 0 for x, n in _COUNTED.items() for o in ("added", "removed", "changed")},
        "items": {"added": _items(changes, diagnostics, "added", "head_key", head), "removed": _items(changes, diagnostics, "removed", "base_key", base)},
        "projects": [r.asDict() for r in rows],
        "references": [r.asDict() for r in added],
        "externals": [{**r.asDict(), "delta": 0} for r in external],
        "fresh": [r["ref"] for r in fresh],
    }
