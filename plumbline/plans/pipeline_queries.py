"""The registered queries of the core's training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import dense_totals, drift, nested, snapshot_diff
from plumbline.operators.snapshot_pairs import consecutive_snapshots, snapshot_roles
from plumbline.session import durable
from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.shred(table(spark, folder, "compact_reports")).select("report_id", "node", "parent_node")


def _bridge(spark: SparkSession, folder: str) -> DataFrame:
    return durable(nested.shred(table(spark, folder, "compact_reports")))


def p1_objects(spark: SparkSession, folder: str) -> DataFrame:
    return nested.object_store(nested.shred(table(spark, folder, "compact_reports")))


def _flat(level: str) -> Query:
    """One level's table with its links by path; the links by identity, ``object_hash`` and ``parent_hash``, are in ``p1_objects``."""
    return lambda spark, folder: nested.flat_table(_bridge(spark, folder), level).drop("object_hash", "parent_hash")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.drift_events(drift.ingest(table(spark, folder, "compact_reports")))


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent table of all files: found renames and other types replayed from the rescued values."""
    rows = durable(drift.ingest(table(spark, folder, "compact_reports")))
    return drift.consistent_table(rows, drift.drift_events(rows)).withColumn("_rescued", drift.rescued_json())


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return dense_totals.dense_key_totals(table(spark, folder, "dependencies"), "from_entity", "reference_count")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    everything = table(spark, folder, "dependencies").agg(F.count(F.lit(1)).alias("n"))
    return dense_totals.heavy_keys(_totals(spark, folder), everything.scalar()).select(F.col("key").alias("from_entity"))


def p4_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _totals(spark, folder).select(F.col("key").alias("from_entity"), F.col("rows").alias("n_rows"), F.col("total").alias("reference_sum"))


def _roles(spark: SparkSession, folder: str) -> DataFrame:
    return durable(snapshot_roles(consecutive_snapshots(table(spark, folder, "snapshots"))))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    roles = _roles(spark, folder)
    diagnostics = snapshot_diff.diagnostic_changes(table(spark, folder, "diagnostic_items"), roles)
    projects = snapshot_diff.project_changes(table(spark, folder, "project_metrics"), roles)
    shape = ["pair", "base_key", "head_key", "outcome"]
    return (
        diagnostics.select(*shape, F.lit("diagnostic").alias("entity"))
        .unionByName(projects.select(*shape, F.lit("project").alias("entity")))
        .select(F.col("pair").alias("head_snapshot_id"), "entity", "base_key", "head_key", "outcome")
    )


def p6_diagnostic_changes(spark: SparkSession, folder: str) -> DataFrame:
    changes = snapshot_diff.diagnostic_changes(table(spark, folder, "diagnostic_items"), _roles(spark, folder))
    return changes.select(F.col("pair").alias("head_snapshot_id"), "base_key", "head_key", "outcome", F.array_join("changed_fields", ",").alias("changed_fields"))


def p6_unmatched_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The diagnostics of both snapshots of a pair that no equal one of the other cancels."""
    cells = snapshot_diff.diagnostic_cells(table(spark, folder, "diagnostic_items"), _roles(spark, folder))
    left = snapshot_diff.surplus_rows(cells, ["pair", "ka", "kb", "line", "col"])
    return left.select(F.col("pair").alias("head_snapshot_id"), "sign", "pos")


def p6_project_changes(spark: SparkSession, folder: str) -> DataFrame:
    changes = snapshot_diff.project_changes(table(spark, folder, "project_metrics"), _roles(spark, folder))
    return changes.select(F.col("pair").alias("head_snapshot_id"), F.col("key").alias("project_key"), "base_key", "head_key", "outcome", F.array_join("changed_fields", ",").alias("changed_fields"))


def _level_sql(name: str, source: str, field: str, path: str) -> str:
    """One level of a payload in DuckDB: the objects that ``field`` of each object of ``source`` holds."""
    return f"""{name} AS (SELECT report_id, node, parent_node, o FROM (
            SELECT report_id, CASE WHEN path = '' THEN '' ELSE path || '.' END || '{field}[' || i || ']' AS node, path AS parent_node,
                   CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[' || i || ']') ELSE v END AS o
            FROM (SELECT report_id, path, v, unnest(range(CASE json_type(v) WHEN 'ARRAY' THEN CAST(json_array_length(v) AS BIGINT) WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS i
                  FROM (SELECT report_id, {path} AS path, json_extract(o, '$.{field}') AS v FROM {source}))) WHERE json_type(o) = 'OBJECT')"""


_LEVELS = [("p", "r", "prj", "''"), ("n", "p", "ns", "node"), ("t1", "p", "types", "node"), ("t2", "n", "types", "node"), ("m1", "t1", "m", "node"), ("m2", "t2", "m", "node")]

_OBJECTS = "WITH r AS (SELECT report_id, CAST(payload AS JSON) AS o FROM (SELECT * FROM compact_reports WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT'), " + ", ".join(_level_sql(*level) for level in _LEVELS)


def _flat_sql(level: str, tables: list[str]) -> str:
    """A level's table in DuckDB; an integer is one by its spelling, as the engine reads it."""
    own = lambda short, kind: {"string": f"json_extract_string(o, '$.{short}')", "double": f"TRY_CAST(json_extract_string(o, '$.{short}') AS DOUBLE)", "int": f"CASE WHEN regexp_full_match(json_extract_string(o, '$.{short}'), '-?[0-9]+') THEN TRY_CAST(json_extract_string(o, '$.{short}') AS INTEGER) END"}[kind]
    fields = ", ".join(f"{own(short, kind)} AS {name}" for short, (name, kind) in nested.COLUMNS[level].items())
    every = " UNION ALL ".join(f"SELECT * FROM {t}" for t in tables)
    return f"{_OBJECTS} SELECT report_id, node, parent_node, regexp_extract(node, '([a-z]+)\\[(\\d+)\\]$', 1) AS field, CAST(regexp_extract(node, '\\[(\\d+)\\]$', 1) AS INTEGER) AS ordinal, {fields} FROM ({every})"


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_objects": p1_objects,
    "p1_projects": _flat("project"),
    "p1_namespaces": _flat("namespace"),
    "p1_types": _flat("type"),
    "p1_methods": _flat("method"),
    "p3_found": p3_found,
    "p3_table": p3_table,
    "p4_found": p4_found,
    "p4_totals": p4_totals,
    "p6_found": p6_found,
    "p6_project_changes": p6_project_changes,
    "p6_diagnostic_changes": p6_diagnostic_changes,
    "p6_unmatched_rows": p6_unmatched_rows,
}

_PAIRS = """s AS (SELECT snapshot_id, min(solution_path) AS solution_path, min(analyzed_at) AS analyzed_at FROM snapshots
                   WHERE solution_path IS NOT NULL AND analyzed_at IS NOT NULL GROUP BY snapshot_id),
        pairs AS (SELECT * FROM (SELECT snapshot_id AS head, lag(snapshot_id) OVER (PARTITION BY solution_path ORDER BY analyzed_at) AS base FROM s) WHERE base IS NOT NULL)"""
_SAME = "head, a, b, severity, c, f, line, col_no"

SQL: dict[str, str] = {
    "p1_found": _OBJECTS + " UNION ALL ".join(f" SELECT report_id, node, parent_node FROM {level[0]}" for level in _LEVELS),
    "p1_projects": _flat_sql("project", ["p"]),
    "p1_namespaces": _flat_sql("namespace", ["n"]),
    "p1_types": _flat_sql("type", ["t1", "t2"]),
    "p1_methods": _flat_sql("method", ["m1", "m2"]),
    "p4_found": """
        SELECT from_entity FROM dependencies WHERE from_entity IS NOT NULL
        GROUP BY from_entity HAVING count(*) > 0.02 * (SELECT count(*) FROM dependencies)""",
    "p4_totals": """
        SELECT from_entity, count(*) AS n_rows, CAST(coalesce(sum(reference_count), 0) AS BIGINT) AS reference_sum
        FROM dependencies GROUP BY from_entity""",
    "p6_project_changes": """
        WITH """
    + _PAIRS
    + """,
        p AS (SELECT snapshot_id, lower(project_name) AS k, min(project_row_id) AS id,
                     arg_min(coalesce(type_count, 0), project_row_id) AS tc, arg_min(coalesce(method_count, 0), project_row_id) AS mc,
                     arg_min(coalesce(total_cc, 0), project_row_id) AS cc, arg_min(coalesce(total_loc, 0), project_row_id) AS loc
              FROM project_metrics WHERE snapshot_id IS NOT NULL GROUP BY 1, 2),
        b AS (SELECT head, p.* FROM pairs JOIN p ON p.snapshot_id = pairs.base),
        h AS (SELECT head, p.* FROM pairs JOIN p ON p.snapshot_id = pairs.head),
        j AS (SELECT coalesce(b.head, h.head) AS head, coalesce(b.k, h.k) AS k, b.id AS bid, h.id AS hid,
                     CASE WHEN b.id IS NOT NULL AND h.id IS NOT NULL THEN concat_ws(',', CASE WHEN b.mc <> h.mc THEN 'method_count' END,
                       CASE WHEN b.cc <> h.cc THEN 'total_cc' END, CASE WHEN b.loc <> h.loc THEN 'total_loc' END, CASE WHEN b.tc <> h.tc THEN 'type_count' END) ELSE '' END AS f
              FROM b FULL JOIN h ON b.head = h.head AND b.k IS NOT DISTINCT FROM h.k)
        SELECT head AS head_snapshot_id, k AS project_key, coalesce(bid, -1) AS base_key, coalesce(hid, -1) AS head_key,
               CASE WHEN bid IS NULL THEN 'added' WHEN hid IS NULL THEN 'removed' ELSE 'changed' END AS outcome, f AS changed_fields
        FROM j WHERE bid IS NULL OR hid IS NULL OR f <> ''""",
    "p6_unmatched_rows": f"""
        WITH {_PAIRS},
        d AS (SELECT * FROM diagnostic_items WHERE pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_id, pos ORDER BY loaded_at DESC) = 1),
        x AS (SELECT head, CASE WHEN snapshot_id = head THEN 1 ELSE -1 END AS sign, pos, lower(project) AS a, lower(id) AS b, severity, lower(message) AS c, lower(file) AS f, line, col_no
              FROM pairs JOIN d ON snapshot_id IN (base, head)),
        y AS (SELECT *, row_number() OVER (PARTITION BY sign, {_SAME} ORDER BY pos) AS k, count(*) FILTER (sign = 1) OVER w AS nh, count(*) FILTER (sign = -1) OVER w AS nb FROM x WINDOW w AS (PARTITION BY {_SAME}))
        SELECT head AS head_snapshot_id, sign, pos FROM y WHERE k > CASE sign WHEN 1 THEN nb ELSE nh END""",
}
