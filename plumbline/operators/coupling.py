"""Edge aggregation and coupling of projects, namespaces and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.metrics import is_bcl, namespace_of
from plumbline.session import durable

PROJECT, NAMESPACE, TYPE = 0, 2, 3
_SCOPE = "snapshot_id"
#: Column that marks a table of aggregated edges.
_TOTAL = "_aggregated"


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """One edge per snapshot, ends and type with the sum of its counts; hot ends sum map-side."""
    return edges.groupBy(_SCOPE, "from_entity", "to_entity", "dep_type").agg(F.sum("reference_count").alias("reference_count"))


def aggregated(edges: DataFrame) -> DataFrame:
    """A durable table of the aggregated edges, marked so that nothing aggregates them again."""
    return durable(aggregate_edges(edges)).withColumn(_TOTAL, F.lit(True))


def edges_of_type(edges: DataFrame, kind: int) -> DataFrame:
    """Aggregated edges of one type; edges that ``aggregate_edges`` has cut down already stay as they are."""
    own = edges.where(F.col("dep_type") == kind)
    return own if _TOTAL in edges.columns else aggregate_edges(own)


def collector_stats(edges: DataFrame) -> DataFrame:
    """Edges added, distinct edges and the share of repeats, per snapshot; the count is of rows, not of references."""
    per = edges.groupBy(_SCOPE, "from_entity", "to_entity", "dep_type").agg(F.count(F.lit(1)).alias("n"))
    stats = per.groupBy(_SCOPE).agg(F.sum("n").alias("total_edges_added"), F.count(F.lit(1)).alias("unique_edges"))
    return stats.withColumn("dedup_ratio", F.when(F.col("total_edges_added") > 0, 1.0 - F.col("unique_edges") / F.col("total_edges_added")).otherwise(0.0))


def missing_edges(declared: DataFrame, supplied: DataFrame) -> DataFrame:
    """Supplied edges followed by the declared ones that they lack."""
    keys = [_SCOPE, "from_entity", "to_entity", "dep_type"]
    return supplied.unionByName(declared.join(supplied.select(*keys).distinct(), keys, "left_anti"))


def _measures(roles: DataFrame) -> DataFrame:
    """Measures per entity from rows ``entity, role, other, reference_count``; roles are out, in, ext.

    The rows come from aggregated edges, so each (entity, role, other) occurs once and counting is counting
    distinct ones: one aggregation, summed map-side.
    """
    count = lambda c: F.count_if(c).alias("n").cast("bigint")
    bcl = is_bcl("other")
    out = roles.groupBy(_SCOPE, "entity").agg(
        count(F.col("role") == "out").alias("id"),
        count(F.col("role") == "in").alias("idx"),
        count((F.col("role") == "ext") & bcl).alias("edb"),
        count((F.col("role") == "ext") & ~bcl).alias("edp"),
        F.coalesce(F.sum(F.when(F.col("role") != "none", F.col("reference_count"))), F.lit(0).cast("bigint")).alias("strength"),
    )
    return out.select(_SCOPE, "entity", "id", "idx", dependency_ratio().alias("dr"), (F.col("edb") + F.col("edp")).alias("ed"), "edb", "edp", "strength")


def dependency_ratio() -> Column:
    both = F.col("id") + F.col("idx")
    return F.when(both > 0, F.col("id") / F.nullif(both, F.lit(0))).otherwise(0.0)


def _both_roles(edges: DataFrame, target_is_internal: Column, external: str) -> DataFrame:
    """Each edge once as outgoing of its source and, since sources are internal, as incoming of its target."""
    role = F.when(target_is_internal, "out").otherwise(external)
    sides = F.array(
        F.struct(F.col("from_entity").alias("entity"), role.alias("role"), F.col("to_entity").alias("other")),
        F.struct(F.col("to_entity").alias("entity"), F.lit("in").alias("role"), F.col("from_entity").alias("other")),
    )
    return edges.select(_SCOPE, "reference_count", F.inline(sides))


def entity_coupling(edges: DataFrame, kind: int) -> DataFrame:
    """Coupling of namespaces or types: internal are the entities with an outgoing edge of the kind.

    One aggregation, one join for the internal flag and one aggregation by role; edges are never
    scanned once per side. An entity that is only a target has its incoming edges.
    """
    own = edges_of_type(edges, kind)
    inside = own.select(_SCOPE, F.col("from_entity").alias("_inside")).distinct()
    flagged = own.join(inside.withColumnRenamed(_SCOPE, "_scope"), (F.col(_SCOPE) == F.col("_scope")) & (F.col("to_entity") == F.col("_inside")), "left")
    return _measures(_both_roles(flagged, F.col("_inside").isNotNull(), "ext"))


def project_coupling(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """Coupling of the listed projects; only edges between listed ones count and nothing is external."""
    own = edges_of_type(edges, PROJECT)
    names = projects.select(_SCOPE, F.col("project_name").alias("entity")).where("entity is not null").distinct()
    ends = own.join(names.select(F.col(_SCOPE).alias("_s1"), F.col("entity").alias("_f")), (F.col(_SCOPE) == F.col("_s1")) & (F.col("from_entity") == F.col("_f")))
    ends = ends.join(names.select(F.col(_SCOPE).alias("_s2"), F.col("entity").alias("_t")), (F.col(_SCOPE) == F.col("_s2")) & (F.col("to_entity") == F.col("_t")))
    idle = names.select(_SCOPE, F.lit(0).cast("bigint").alias("reference_count"), "entity", F.lit("none").alias("role"), F.lit(None).cast("string").alias("other"))
    return _measures(_both_roles(ends, F.lit(True), "ext").unionByName(idle))


def all_coupling(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """The three layers on end, with their order, from one aggregation of the edges."""
    edges = edges if _TOTAL in edges.columns else aggregated(edges)
    layer = lambda df, name, at: df.select(F.lit(name).alias("layer"), F.lit(at).alias("layer_no"), "*")
    return (
        layer(project_coupling(edges, projects), "project", 0)
        .unionByName(layer(entity_coupling(edges, NAMESPACE), "namespace", 1))
        .unionByName(layer(entity_coupling(edges, TYPE), "type", 2))
    )


def single_project_coupling(edges: DataFrame, project: str) -> DataFrame:
    """Namespaces and types of a project that is analysed alone, whose own row is all zeros."""
    edges = edges if _TOTAL in edges.columns else aggregated(edges)
    zero = F.lit(0).cast("bigint")
    layers = [entity_coupling(edges, kind).select(F.lit(name).alias("layer"), "*") for kind, name in ((NAMESPACE, "namespace"), (TYPE, "type"))]
    own = edges.select(_SCOPE).distinct().select(F.lit("project").alias("layer"), _SCOPE, F.lit(project).alias("entity"), *[F.lit(0.0).alias(c) if c == "dr" else zero.alias(c) for c in ("id", "idx", "dr", "ed", "edb", "edp", "strength")])
    return layers[0].unionByName(layers[1]).unionByName(own)


def coupling_summary(coupling: DataFrame, edges: DataFrame) -> DataFrame:
    """Averages over all entities of a snapshot, its edges, and the first entity with each largest measure.

    Ties go to the earlier layer, then to the name in binary order.
    """
    tie = lambda c: F.min_by("entity", F.struct(-F.col(c), F.col("layer_no"), F.col("entity")))
    means = [F.avg(c).alias(f"avg_{c}") for c in ("id", "idx", "dr", "ed", "edb", "edp")]
    summary = coupling.groupBy(_SCOPE).agg(*means, tie("strength").alias("most_coupled"), tie("idx").alias("most_dependent"), tie("dr").alias("highest_consumer"))
    each = edges if _TOTAL in edges.columns else aggregate_edges(edges)
    return summary.join(each.groupBy(_SCOPE).agg(F.count(F.lit(1)).alias("total_dependencies")), _SCOPE, "left")


# ---- graph layers


def numbered(nodes: DataFrame, order: str) -> DataFrame:
    """0-based ids in name order within each snapshot."""
    return nodes.withColumn("node_id", F.row_number().over(Window.partitionBy(_SCOPE).orderBy(order)) - 1)


def graph_edges(edges: DataFrame, nodes: DataFrame, kind: int, loops: bool) -> DataFrame:
    """``source, target, weight`` between nodes; edges with an end that is no node are left out."""
    own = edges_of_type(edges, kind)
    if not loops:
        own = own.where("from_entity != to_entity")
    ids = nodes.select(F.col(_SCOPE).alias("_s"), F.col("name").alias("_n"), F.col("node_id").alias("_id"))
    source = ids.toDF("_s1", "_n1", "source")
    target = ids.toDF("_s2", "_n2", "target")
    return (
        own.join(source, (F.col(_SCOPE) == F.col("_s1")) & (F.col("from_entity") == F.col("_n1")))
        .join(target, (F.col(_SCOPE) == F.col("_s2")) & (F.col("to_entity") == F.col("_n2")))
        .groupBy(_SCOPE, "source", "target")
        .agg(F.sum("reference_count").alias("weight"))
    )


def entity_nodes(edges: DataFrame, kind: int) -> DataFrame:
    """``snapshot_id, name, node_id`` of the entities with an outgoing edge of the kind, numbered in name order."""
    own = edges_of_type(edges, kind)
    return numbered(own.select(_SCOPE, F.col("from_entity").alias("name")).distinct(), "name")


def derived_namespace_edges(edges: DataFrame) -> DataFrame:
    """The namespace edges that type edges give: one per type edge that leaves its namespace for a named one."""
    own = edges_of_type(edges, TYPE).select(_SCOPE, namespace_of("from_entity", "").alias("from_entity"), namespace_of("to_entity", "").alias("to_entity"), "reference_count")
    crossing = own.where("from_entity != to_entity and to_entity != ''")
    return aggregate_edges(crossing.withColumn("dep_type", F.lit(NAMESPACE)))


def out_weights(links: DataFrame) -> DataFrame:
    return links.groupBy(_SCOPE, F.col("source").alias("node_id")).agg(F.sum("weight").alias("dep_count"))


def min_max(value: str, keys: list[str]) -> Column:
    """(v - min) / (max - min) within ``keys``; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0)


def radius(value: str, keys: list[str]) -> Column:
    """15 to 200 by the value's place between at most 0 and at least 1; halfway where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.least(F.min(value).over(w), F.lit(0.0)), F.greatest(F.max(value).over(w), F.lit(1.0))
    ratio = F.when(high > low, (F.col(value) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)
    return 15.0 + ratio * 185.0
