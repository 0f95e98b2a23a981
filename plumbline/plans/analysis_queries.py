"""The registered queries of the analytics and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import metrics as fn
from plumbline.operators import coupling, diff, references, rollup, snapshot_diff
from plumbline.operators.snapshot_pairs import consecutive_snapshots, snapshot_roles
from plumbline.operators.tokens import OPERAND_WORDS, OPERATOR_SYMBOLS, OPERATOR_WORDS, PATTERN, RESERVED, depth_of_inheritance, halstead
from plumbline.session import durable
from plumbline.sources.frontend import source_facts
from plumbline.sources.model import Model
from plumbline.sources.reports import compact_projects, compact_reports, graph_document, graphs_of_layers, hierarchical_reports, project_measures
from plumbline.sources.tables import table
from plumbline.streaming.edges import drain, edge_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: DuckDB forms of the model tables: the latest delivery of each row, and all rows whose key has a null.
_CTE = {
    "m": """m AS (SELECT method_id, snapshot_id, project, type_id, full_name, file_path, start_line, end_line, cyclomatic_complexity AS cc,
                  lines_of_executable_code AS loc, halstead_volume AS hv, CASE WHEN NOT isnan(maintainability_index) THEN maintainability_index END AS mi FROM method_metrics QUALIFY method_id IS NULL OR row_number() OVER (PARTITION BY method_id ORDER BY loaded_at DESC) = 1)""",
    "t": "t AS (SELECT type_id, snapshot_id, project, full_name, depth_of_inheritance AS dit FROM type_metrics QUALIFY type_id IS NULL OR row_number() OVER (PARTITION BY type_id ORDER BY loaded_at DESC) = 1)",
    "pr": "pr AS (SELECT * FROM project_metrics QUALIFY project_row_id IS NULL OR row_number() OVER (PARTITION BY project_row_id ORDER BY loaded_at DESC) = 1)",
    "d": "d AS (SELECT * FROM diagnostic_items QUALIFY snapshot_id IS NULL OR pos IS NULL OR row_number() OVER (PARTITION BY snapshot_id, pos ORDER BY loaded_at DESC) = 1)",
    "s": "s AS (SELECT * FROM snapshots QUALIFY snapshot_id IS NULL OR row_number() OVER (PARTITION BY snapshot_id ORDER BY loaded_at DESC) = 1)",
    "e": """e AS (SELECT snapshot_id, from_entity, to_entity, dep_type, CAST(coalesce(reference_count, 0) AS BIGINT) AS n FROM dependencies
                  WHERE trim(from_entity) <> '' AND trim(to_entity) <> '')""",
    "a": "a AS (SELECT snapshot_id, from_entity, to_entity, dep_type, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL)",
    "pairs": """pairs AS (SELECT * FROM (SELECT snapshot_id AS head, lag(snapshot_id) OVER (PARTITION BY solution_path ORDER BY analyzed_at) AS base
                  FROM s WHERE solution_path IS NOT NULL AND analyzed_at IS NOT NULL) WHERE base IS NOT NULL)""",
    "pt": """pt AS (SELECT t.*, CASE WHEN length(full_name) - length(split_part(full_name, '.', -1)) > 1
                  THEN substring(full_name, 1, length(full_name) - length(split_part(full_name, '.', -1)) - 1) ELSE '(global)' END AS namespace,
                  coalesce(k, 0) AS k, coalesce(cc, 0) AS cc, coalesce(loc, 0) AS loc, coalesce(mis, 0) AS mis, coalesce(min_, 0) AS min_
                  FROM t LEFT JOIN (SELECT type_id AS ti, count(*) AS k, sum(cc) AS cc, sum(loc) AS loc, sum(CAST(mi AS DECIMAL(28,10))) AS mis, count(mi) AS min_ FROM m WHERE type_id IS NOT NULL GROUP BY 1) ON type_id = ti)""",
}
_BCL = "(x = 'System' OR x LIKE 'System.%' OR x LIKE 'Microsoft.%')"


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(_CTE[n] for n in names)


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Model(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return register


_SUMS = """CAST(coalesce(sum(k), 0) AS BIGINT) AS method_count, CAST(coalesce(sum(cc), 0) AS BIGINT) AS total_cc, CAST(coalesce(sum(loc), 0) AS BIGINT) AS total_loc,
        round_even(CASE WHEN sum(min_) > 0 THEN CAST(sum(mis) AS DOUBLE) / sum(min_) ELSE 0 END * 10000, 0) / 10000 AS avg_mi"""


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Means are sums of doubles in no fixed order; what is shown is rounded half to even."""
    for c in columns:
        df = df.withColumn(c, fn.round_even(c, digits))
    return df


# ---- edges and coupling


@query("a1_edges", f"{_with('e')} SELECT snapshot_id, from_entity, to_entity, dep_type, CAST(sum(n) AS BIGINT) AS reference_count FROM e GROUP BY ALL")
def a1_edges(m: Model) -> DataFrame:
    return coupling.aggregate_edges(m.edges())


@query("a3_edges_sql", SQL["a1_edges"])
def a3_edges_sql(m: Model) -> DataFrame:
    return m.spark.sql("SELECT snapshot_id, from_entity, to_entity, dep_type, SUM(reference_count) AS reference_count FROM {edges} GROUP BY snapshot_id, from_entity, to_entity, dep_type", edges=m.edges())


@query("a4_edges_by_type", f"{_with('e')} SELECT snapshot_id, from_entity, to_entity, dep_type, CAST(sum(n) AS BIGINT) AS reference_count FROM e WHERE dep_type = 2 GROUP BY ALL")
def a4_edges_by_type(m: Model) -> DataFrame:
    return coupling.edges_of_type(m.edges(), coupling.NAMESPACE)


@query("a6_collector_stats", f"{_with('e', 'a')} SELECT snapshot_id, total_edges_added, unique_edges, CASE WHEN total_edges_added > 0 THEN 1.0::DOUBLE - unique_edges::DOUBLE / total_edges_added ELSE 0.0::DOUBLE END AS dedup_ratio FROM (SELECT snapshot_id, count(*) AS total_edges_added FROM e GROUP BY 1) JOIN (SELECT snapshot_id, count(*) AS unique_edges FROM a GROUP BY 1) USING (snapshot_id)")
def a6_collector_stats(m: Model) -> DataFrame:
    return coupling.collector_stats(m.edges())


@query("a7_distinct_edges", f"{_with('e', 'a')} SELECT count(*) AS unique_edges FROM a")
def a7_distinct_edges(m: Model) -> DataFrame:
    return coupling.aggregate_edges(m.edges()).agg(F.count(F.lit(1)).alias("unique_edges"))


def _coupling_sql(kind: int) -> str:
    return f"""inn{kind} AS (SELECT DISTINCT snapshot_id, from_entity AS x FROM a WHERE dep_type = {kind}),
        r{kind} AS (SELECT a.snapshot_id, from_entity AS entity, CASE WHEN x IS NOT NULL THEN 'out' ELSE 'ext' END AS role, to_entity AS other, n
               FROM a LEFT JOIN inn{kind} ON inn{kind}.snapshot_id = a.snapshot_id AND x = to_entity WHERE dep_type = {kind}
               UNION ALL SELECT snapshot_id, to_entity, 'in', from_entity, n FROM a WHERE dep_type = {kind})"""


_PROJECT_ROLES = """names AS (SELECT DISTINCT snapshot_id, project_name AS x FROM pr WHERE project_name IS NOT NULL),
        pe AS (SELECT a.* FROM a JOIN names f ON f.snapshot_id = a.snapshot_id AND f.x = from_entity JOIN names t ON t.snapshot_id = a.snapshot_id AND t.x = to_entity WHERE dep_type = 0),
        r0 AS (SELECT snapshot_id, from_entity AS entity, 'out' AS role, to_entity AS other, n FROM pe UNION ALL SELECT snapshot_id, to_entity, 'in', from_entity, n FROM pe
               UNION ALL SELECT snapshot_id, x, 'none', NULL, 0 FROM names)"""


def _measure_sql(roles: str) -> str:
    return f"""SELECT snapshot_id, entity, id, idx, CASE WHEN id + idx > 0 THEN id::DOUBLE / (id + idx) ELSE 0.0::DOUBLE END AS dr, edb + edp AS ed, edb, edp, strength FROM (
        SELECT snapshot_id, entity, count(DISTINCT CASE WHEN role = 'out' THEN other END) AS id, count(DISTINCT CASE WHEN role = 'in' THEN other END) AS idx,
               count(DISTINCT CASE WHEN role = 'ext' AND {_BCL.replace('x ', 'other ')} THEN other END) AS edb,
               count(DISTINCT CASE WHEN role = 'ext' AND NOT {_BCL.replace('x ', 'other ')} THEN other END) AS edp, CAST(sum(n) AS BIGINT) AS strength
        FROM {roles} GROUP BY 1, 2)"""


@query("a15_project_coupling", f"{_with('e', 'a', 'pr')}, {_PROJECT_ROLES} {_measure_sql('r0')}")
def a15_project_coupling(m: Model) -> DataFrame:
    return coupling.project_coupling(m.edges(), m.projects())


@query("a16_namespace_coupling", f"{_with('e', 'a')}, {_coupling_sql(2)} {_measure_sql('r2')}")
def a16_namespace_coupling(m: Model) -> DataFrame:
    return coupling.entity_coupling(m.edges(), coupling.NAMESPACE)


@query("a16_type_coupling", f"{_with('e', 'a')}, {_coupling_sql(3)} {_measure_sql('r3')}")
def a16_type_coupling(m: Model) -> DataFrame:
    return coupling.entity_coupling(m.edges(), coupling.TYPE)


_ALL = f"""c AS (SELECT 0 AS ln, * FROM ({_measure_sql('r0')}) UNION ALL SELECT 1, * FROM ({_measure_sql('r2')}) UNION ALL SELECT 2, * FROM ({_measure_sql('r3')}))"""


@query(
    "a18_coupling_summary",
    f"""{_with('e', 'a', 'pr')}, {_PROJECT_ROLES}, {_coupling_sql(2)}, {_coupling_sql(3)}, {_ALL},
    k AS (SELECT snapshot_id, {', '.join(f'round_even(avg({x}) * 10000, 0) / 10000 AS avg_{x}' for x in ('id', 'idx', 'dr', 'ed', 'edb', 'edp'))} FROM c GROUP BY 1),
    {', '.join(f"w{i} AS (SELECT snapshot_id, entity FROM c QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY {x} DESC, ln, entity) = 1)" for i, x in enumerate(('strength', 'idx', 'dr')))},
    n AS (SELECT snapshot_id, count(*) AS total_dependencies FROM a GROUP BY 1)
    SELECT k.*, w0.entity AS most_coupled, w1.entity AS most_dependent, w2.entity AS highest_consumer, total_dependencies
    FROM k JOIN w0 USING (snapshot_id) JOIN w1 USING (snapshot_id) JOIN w2 USING (snapshot_id) LEFT JOIN n USING (snapshot_id)""",
)
def a18_coupling_summary(m: Model) -> DataFrame:
    edges = coupling.aggregated(m.edges())
    summary = coupling.coupling_summary(durable(coupling.all_coupling(edges, m.projects())), edges)
    return _rounded(summary, *[f"avg_{c}" for c in ("id", "idx", "dr", "ed", "edb", "edp")])


@query(
    "j10_missing_project_edges",
    f"""{_with('e', 'a')} SELECT snapshot_id, from_entity, to_entity, dep_type, n AS reference_count FROM a WHERE dep_type = 2
    UNION ALL SELECT snapshot_id, from_entity, to_entity, 2, 1 FROM a x WHERE dep_type = 0 AND NOT EXISTS (SELECT 1 FROM a y WHERE y.dep_type = 2 AND y.snapshot_id = x.snapshot_id AND y.from_entity = x.from_entity AND y.to_entity = x.to_entity)""",
)
def j10_missing_project_edges(m: Model) -> DataFrame:
    declared = coupling.edges_of_type(m.edges(), 0).select("snapshot_id", "from_entity", "to_entity", F.lit(2).alias("dep_type"), F.lit(1).cast("bigint").alias("reference_count"))
    return coupling.missing_edges(declared, coupling.edges_of_type(m.edges(), 2))


# ---- rollups

_PT = _with("m", "t", "pt")


@query("a21_type_rollup", f"{_PT} SELECT type_id, k AS method_count, CAST(cc AS BIGINT) AS total_cc, CAST(loc AS BIGINT) AS total_loc, namespace FROM pt")
def a21_type_rollup(m: Model) -> DataFrame:
    return rollup.type_rollup(m.types(), m.methods()).select("type_id", F.col("n_methods").alias("method_count"), F.col("cc").alias("total_cc"), F.col("loc").alias("total_loc"), "namespace")


@query("a22_namespace_rollup", f"{_PT} SELECT snapshot_id, project, namespace, count(*) AS type_count, {_SUMS}, coalesce(max(dit), 0) AS max_dit FROM pt GROUP BY 1, 2, 3")
def a22_namespace_rollup(m: Model) -> DataFrame:
    return _rounded(rollup.namespace_rollup(rollup.type_rollup(m.types(), m.methods())), "avg_mi")


@query("a29_namespace_across_projects", f"{_PT} SELECT snapshot_id, namespace, count(*) AS type_count, {_SUMS}, coalesce(max(dit), 0) AS max_dit FROM pt GROUP BY 1, 2")
def a29_namespace_across_projects(m: Model) -> DataFrame:
    return _rounded(rollup.namespace_rollup(rollup.type_rollup(m.types(), m.methods()), across_projects=True), "avg_mi")


@query(
    "a24_hierarchy",
    f"""{_PT} SELECT snapshot_id, project, namespace, count(*) AS type_count, {_SUMS}, coalesce(max(dit), 0) AS max_dit,
    CASE grouping_id(snapshot_id, project, namespace) WHEN 0 THEN 'namespace' WHEN 1 THEN 'project' WHEN 3 THEN 'snapshot' ELSE 'all' END AS level
    FROM pt GROUP BY ROLLUP (snapshot_id, project, namespace)""",
)
def a24_hierarchy(m: Model) -> DataFrame:
    return _rounded(rollup.hierarchy(rollup.type_rollup(m.types(), m.methods())), "avg_mi")


@query("a43_unweighted_maintainability", f"{_PT}, p AS (SELECT snapshot_id, project, CASE WHEN sum(min_) > 0 THEN CAST(sum(mis) AS DOUBLE) / sum(min_) ELSE 0 END AS v FROM pt GROUP BY 1, 2) SELECT snapshot_id, round_even(avg(v) * 1000, 0) / 1000 AS avg_project_mi FROM p GROUP BY 1")
def a43_unweighted_maintainability(m: Model) -> DataFrame:
    per = rollup.type_rollup(m.types(), m.methods()).groupBy("snapshot_id", "project").agg(F.coalesce(F.sum("mi_sum").cast("double") / F.nullif(F.sum("mi_n"), F.lit(0)), F.lit(0.0)).alias("v"))
    return _rounded(per.groupBy("snapshot_id").agg(F.avg("v").alias("avg_project_mi")), "avg_project_mi", digits=3)


def _top_sql(measure: str, keep: str, order: str) -> str:
    return f"""{_with('m')} SELECT snapshot_id, project, CAST(rank_no AS INTEGER) AS rank_no, method_id, {measure} AS measure FROM (
        SELECT *, row_number() OVER (PARTITION BY snapshot_id, project ORDER BY {measure} {order}, full_name, method_id) AS rank_no FROM m WHERE {keep}) WHERE rank_no <= 5"""


@query("w3_top_complexity", _top_sql("cc", "cc > 10", "DESC"))
def w3_top_complexity(m: Model) -> DataFrame:
    top = rollup.top_methods(m.methods(), "cyclomatic_complexity", F.col("cyclomatic_complexity") > 10, True)
    return top.select("snapshot_id", "project", "rank_no", "method_id", F.col("cyclomatic_complexity").alias("measure"))


@query("w3_low_maintainability", _top_sql("mi", "mi < 40", "ASC"))
def w3_low_maintainability(m: Model) -> DataFrame:
    top = rollup.top_methods(m.methods(), "maintainability_index", F.col("maintainability_index") < 40, False)
    return top.select("snapshot_id", "project", "rank_no", "method_id", F.col("maintainability_index").alias("measure"))


@query("t3_top_methods", f"{_with('m')} SELECT method_id, cc AS cyclomatic_complexity, (SELECT count(*) FROM m WHERE cc > 10) - 5 AS more FROM m WHERE cc > 10 ORDER BY cc DESC, method_id LIMIT 5")
def t3_top_methods(m: Model) -> DataFrame:
    rows = m.methods().where("cyclomatic_complexity > 10").select("method_id", "cyclomatic_complexity")
    return rollup.overflow(rows, [F.desc("cyclomatic_complexity"), F.asc("method_id")], 5)


@query("t13_diagnostics_page", f"{_with('d')} SELECT snapshot_id, pos, id FROM d WHERE severity >= 1 AND (contains(lower(message), 'branch') OR contains(lower(project), 'branch') OR contains(lower(id), 'branch') OR contains(lower(file), 'branch') OR contains(CAST(line AS VARCHAR), 'branch')) ORDER BY snapshot_id, pos LIMIT 100 OFFSET 100")
def t13_diagnostics_page(m: Model) -> DataFrame:
    rows = m.diagnostics().where(F.col("severity") >= 1).where(rollup.contains_anywhere(["message", "project", "id", "file", "line"], "Branch"))
    return rollup.page(rows.select("snapshot_id", "pos", "id"), [F.asc("snapshot_id"), F.asc("pos")], 2)


@query("f1_names", f"{_PT} SELECT method_id, CASE WHEN instr(full_name, '(') > 0 THEN split_part(split_part(full_name, '(', 1), '.', -1) || substring(full_name, instr(full_name, '(')) ELSE split_part(full_name, '.', -1) END AS short_name FROM m")
def f1_names(m: Model) -> DataFrame:
    return m.methods().select("method_id", fn.short_name("full_name").alias("short_name"))


@query("f8_maintainability", f"{_with('m')} SELECT method_id, CASE WHEN hv <= 0 OR loc <= 0 THEN 100.0::DOUBLE ELSE round_even(greatest(0, least(100, (171 - 5.2::DOUBLE * ln(hv) - 0.23::DOUBLE * cc - 16.2::DOUBLE * ln(loc)) * 100 / 171)) * 10, 0) / 10 END AS index_now FROM m WHERE hv IS NOT NULL AND NOT isnan(hv) AND cc IS NOT NULL AND loc IS NOT NULL")
def f8_maintainability(m: Model) -> DataFrame:
    known = m.methods().where("halstead_volume is not null and not isnan(halstead_volume) and cyclomatic_complexity is not null and lines_of_executable_code is not null")
    return known.select("method_id", fn.round_even(fn.maintainability_index("halstead_volume", "cyclomatic_complexity", "lines_of_executable_code"), 1).alias("index_now"))


@query(
    "f18_snapshot_labels",
    f"""{_with('s')} SELECT snapshot_id, CASE WHEN trim(coalesce(commit_sha, '')) = '' THEN 'unknown' ELSE left(commit_sha, 7) END AS short_sha,
    regexp_replace(branch_name, '[<>:"|?*/\\\\\\x00-\\x1f]', '_', 'g') AS branch_file, strftime(analyzed_at, '%Y-%m-%d %H:%M:%S UTC') AS analyzed, epoch_us(analyzed_at) // 1000 AS millis FROM s""",
)
def f18_snapshot_labels(m: Model) -> DataFrame:
    at = F.col("analyzed_at").cast("timestamp")
    return m.snapshots().select(
        "snapshot_id", fn.short_sha("commit_sha").alias("short_sha"), fn.sanitised_branch("branch_name").alias("branch_file"), F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'").alias("analyzed"), F.unix_millis(at).alias("millis")
    )


# ---- graph layers

_NODES = f"""ns AS (SELECT snapshot_id, namespace AS name, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(cc) AS BIGINT) AS cc,
        round_even(CASE WHEN sum(min_) > 0 THEN CAST(sum(mis) AS DOUBLE) / sum(min_) ELSE 0 END * 10, 0) / 10 AS mi, count(*) AS tc, CAST(sum(k) AS BIGINT) AS mc FROM pt WHERE namespace <> '(global)' GROUP BY 1, 2),
        nn AS (SELECT CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY name) - 1 AS INTEGER) AS node_id, * FROM ns)"""


def _namespace_nodes(m: Model) -> DataFrame:
    types = rollup.type_rollup(m.types(), m.methods()).where("namespace != '(global)'")
    per = rollup.namespace_rollup(types, across_projects=True)
    nodes = per.select("snapshot_id", F.col("namespace").alias("name"), F.col("total_loc").alias("loc"), F.col("total_cc").alias("cc"), fn.round_even("avg_mi", 1).alias("mi"), F.col("type_count").alias("tc"), F.col("method_count").alias("mc"))
    return coupling.numbered(nodes, "name")


@query(
    "g5_namespace_nodes",
    f"""{_with('m', 't', 'pt', 'e', 'a')}, {_NODES}, {_coupling_sql(2)}, c AS ({_measure_sql('r2')})
    SELECT nn.*, coalesce(id, 0) AS id, coalesce(idx, 0) AS idx, coalesce(round_even(dr * 100, 0) / 100, 0) AS dr, coalesce(ed, 0) AS ed FROM nn LEFT JOIN c ON c.snapshot_id = nn.snapshot_id AND entity = name""",
)
def g5_namespace_nodes(m: Model) -> DataFrame:
    found = coupling.entity_coupling(m.edges(), coupling.NAMESPACE).select(F.col("snapshot_id").alias("_s"), "entity", "id", "idx", fn.round_even("dr", 2).alias("dr"), "ed")
    joined = _namespace_nodes(m).join(found, (F.col("snapshot_id") == F.col("_s")) & (F.col("name") == F.col("entity")), "left").drop("_s", "entity")
    return joined.na.fill(0, ["id", "idx", "ed"]).na.fill(0.0, ["dr"])


@query(
    "g5_namespace_edges",
    f"""{_with('m', 't', 'pt', 'e', 'a')}, {_NODES} SELECT a.snapshot_id, f.node_id AS source, t2.node_id AS target, CAST(sum(n) AS BIGINT) AS weight FROM a
    JOIN nn f ON f.snapshot_id = a.snapshot_id AND f.name = from_entity JOIN nn t2 ON t2.snapshot_id = a.snapshot_id AND t2.name = to_entity WHERE dep_type = 2 AND from_entity <> to_entity GROUP BY 1, 2, 3""",
)
def g5_namespace_edges(m: Model) -> DataFrame:
    return coupling.graph_edges(m.edges(), durable(_namespace_nodes(m)), coupling.NAMESPACE, loops=False)


_PNODES = "pn AS (SELECT snapshot_id, project_name AS name, CAST(coalesce(total_loc, 0) AS BIGINT) AS loc, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY project_name) - 1 AS INTEGER) AS node_id FROM pr WHERE project_name IS NOT NULL)"


def _project_nodes(m: Model) -> DataFrame:
    rows = m.projects().where("project_name is not null")
    return coupling.numbered(rows.select("snapshot_id", F.col("project_name").alias("name"), F.coalesce(F.col("total_loc").cast("bigint"), F.lit(0)).alias("loc")), "name")


@query("g4_project_nodes", f"{_with('pr')}, {_PNODES} SELECT * FROM pn")
def g4_project_nodes(m: Model) -> DataFrame:
    return _project_nodes(m)


@query(
    "g4_project_edges",
    f"{_with('pr', 'e', 'a')}, {_PNODES} SELECT a.snapshot_id, f.node_id AS source, t2.node_id AS target, CAST(sum(n) AS BIGINT) AS weight FROM a JOIN pn f ON f.snapshot_id = a.snapshot_id AND f.name = from_entity JOIN pn t2 ON t2.snapshot_id = a.snapshot_id AND t2.name = to_entity WHERE dep_type = 0 GROUP BY 1, 2, 3",
)
def g4_project_edges(m: Model) -> DataFrame:
    return coupling.graph_edges(m.edges(), durable(_project_nodes(m)), coupling.PROJECT, loops=True)


@query(
    "w6_node_radius",
    f"""{_with('pr')}, {_PNODES}, w AS (SELECT *, least(min(loc) OVER (PARTITION BY snapshot_id), 0) AS lo, greatest(max(loc) OVER (PARTITION BY snapshot_id), 1) AS hi,
        min(loc) OVER (PARTITION BY snapshot_id) AS l, max(loc) OVER (PARTITION BY snapshot_id) AS h FROM pn)
    SELECT snapshot_id, name, round_even((15 + (loc - lo)::DOUBLE / (hi - lo) * 185) * 1000, 0) / 1000 AS radius, CASE WHEN h > l THEN round_even((loc - l)::DOUBLE / (h - l) * 1000, 0) / 1000 ELSE 0.0::DOUBLE END AS ratio FROM w""",
)
def w6_node_radius(m: Model) -> DataFrame:
    nodes = _project_nodes(m).withColumn("loc", F.col("loc").cast("double"))
    return _rounded(nodes.select("snapshot_id", "name", coupling.radius("loc", ["snapshot_id"]).alias("radius"), coupling.min_max("loc", ["snapshot_id"]).alias("ratio")), "radius", "ratio", digits=3)


@query("g6_out_weight", f"{_with('m', 't', 'pt', 'e', 'a')}, {_NODES} SELECT a.snapshot_id, f.node_id, CAST(sum(n) AS BIGINT) AS dep_count FROM a JOIN nn f ON f.snapshot_id = a.snapshot_id AND f.name = from_entity JOIN nn t2 ON t2.snapshot_id = a.snapshot_id AND t2.name = to_entity WHERE dep_type = 2 AND from_entity <> to_entity GROUP BY 1, 2")
def g6_out_weight(m: Model) -> DataFrame:
    return coupling.out_weights(g5_namespace_edges(m))


# ---- diagnostics


@query(
    "dg_kept",
    f"""{_with('d')} SELECT snapshot_id, pos, id, CASE severity WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 3 THEN 'error' ELSE 'hidden' END AS level,
    split_part(replace(file, '\\', '/'), '/', -1) AS file_name, coalesce(category, '') AS category FROM d
    WHERE (severity <> 0 OR upper(id) LIKE 'CS%') AND NOT (list_contains(string_split(lower(replace(file, '\\', '/')), '/'), 'obj') OR lower(file) LIKE '%.g.cs' OR lower(file) LIKE '%.g.i.cs' OR lower(file) LIKE '%.designer.cs')""",
)
def dg_kept(m: Model) -> DataFrame:
    kept = m.diagnostics().where(fn.keeps_diagnostic("severity", "id", "file"))
    return kept.select("snapshot_id", "pos", "id", fn.severity_label("severity").alias("level"), fn.basename("file").alias("file_name"), F.coalesce("category", F.lit("")).alias("category"))


_LEVELS = ", ".join(f"count(*) FILTER (severity = {k}) AS {n}" for k, n in enumerate(("hidden_n", "info", "warnings", "errors")))


@query("a31_diagnostics_per_project", f"{_with('d')} SELECT snapshot_id, project, {_LEVELS}, count(*) FILTER (severity = 3) = 0 AS succeeded FROM d GROUP BY 1, 2")
def a31_diagnostics_per_project(m: Model) -> DataFrame:
    counts = [F.count_if(F.col("severity") == k).alias(n) for k, n in enumerate(("hidden_n", "info", "warnings", "errors"))]
    return m.diagnostics().groupBy("snapshot_id", "project").agg(*counts).withColumn("succeeded", F.col("errors") == 0)


@query("a32_diagnostics_totals", f"{_with('d')} SELECT snapshot_id, {_LEVELS} FROM d WHERE project IS NOT NULL GROUP BY 1")
def a32_diagnostics_totals(m: Model) -> DataFrame:
    per = a31_diagnostics_per_project(m).where("project is not null")
    return per.groupBy("snapshot_id").agg(*[F.sum(n).alias(n) for n in ("hidden_n", "info", "warnings", "errors")])


@query("pr11_minimum_level", f"{_with('d')} SELECT project, count(*) AS n FROM d WHERE severity >= 2 GROUP BY 1")
def p11_minimum_level(m: Model) -> DataFrame:
    return m.diagnostics().where(F.col("severity") >= 2).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


# ---- differences


def _pairs(m: Model) -> DataFrame:
    return durable(consecutive_snapshots(m.snapshots()))


#: Packages in DuckDB: references whose target is no listed project.
_PACKAGES = f"""pk AS (SELECT r.* FROM (SELECT DISTINCT snapshot_id, from_entity AS project, to_entity AS ref FROM e WHERE dep_type = 0) r
        LEFT JOIN (SELECT DISTINCT snapshot_id, project_name AS x FROM pr WHERE project_name IS NOT NULL) n ON n.snapshot_id = r.snapshot_id AND n.x = r.ref WHERE n.x IS NULL),
        pkc AS (SELECT snapshot_id, project, count(*) AS ed, count(*) FILTER ({_BCL.replace('x ', 'ref ')}) AS edb, count(*) FILTER (NOT {_BCL.replace('x ', 'ref ')}) AS edp FROM pk GROUP BY 1, 2)"""
#: The measures of a project beyond those in its row.
_WIDE = f"""{_PROJECT_ROLES}, c0 AS ({_measure_sql('r0')}), {_PACKAGES},
        q0 AS (SELECT snapshot_id, project, round_even(CASE WHEN sum(min_) > 0 THEN CAST(sum(mis) AS DOUBLE) / sum(min_) ELSE 0 END * 10, 0) / 10 AS mi FROM pt GROUP BY 1, 2),
        pw AS (SELECT pr.*, coalesce(q0.mi, 0.0::DOUBLE) AS mi, coalesce(c0.id, 0) AS id, coalesce(c0.idx, 0) AS idx, coalesce(round_even(c0.dr * 100, 0) / 100, 0.0::DOUBLE) AS dr, coalesce(c0.ed, 0) AS ed,
                      coalesce(pkc.ed, 0) AS packages, coalesce(pkc.edb, 0) AS edb, coalesce(pkc.edp, 0) AS edp
               FROM pr LEFT JOIN q0 ON q0.snapshot_id = pr.snapshot_id AND q0.project = project_name LEFT JOIN c0 ON c0.snapshot_id = pr.snapshot_id AND c0.entity = project_name
               LEFT JOIN pkc ON pkc.snapshot_id = pr.snapshot_id AND pkc.project = project_name)"""
_PM = [*diff.PROJECT_MEASURES, *diff.FURTHER_MEASURES]


def _delta_sql(measure: str) -> str:
    digits = diff.FURTHER_MEASURES.get(measure, 0)
    side = lambda x: f"coalesce({x}.{measure}, 0)::DOUBLE" if digits else f"CAST(coalesce({x}.{measure}, 0) AS BIGINT)"
    delta = f"round_even(({side('h')} - {side('b')}) * {10**digits}, 0) / {10**digits}" if digits else f"{side('h')} - {side('b')}"
    return f"{side('b')} AS base_{measure}, {side('h')} AS head_{measure}, {delta} AS {measure}_delta"


_J1 = f"""{_WIDE}, j AS (SELECT coalesce(b.head, h.head) AS head, coalesce(h.project_name, b.project_name) AS project, b.head IS NULL AS is_added, h.head IS NULL AS is_removed,
        {', '.join(map(_delta_sql, _PM))}
        FROM (SELECT head, pw.* FROM pairs JOIN pw ON snapshot_id = base WHERE project_name IS NOT NULL) b
        FULL JOIN (SELECT head, pw.* FROM pairs JOIN pw ON snapshot_id = head WHERE project_name IS NOT NULL) h ON b.head = h.head AND lower(b.project_name) = lower(h.project_name))"""
_DIFF = ("s", "pairs", "m", "t", "pt", "pr", "e", "a")


@query("j1_project_diff", f"{_with(*_DIFF)}, {_J1} SELECT head AS head_snapshot_id, * EXCLUDE (head) FROM j")
def j1_project_diff(m: Model) -> DataFrame:
    """All measures of a project; ``ed`` is that of its coupling, which has no external edges, ``edb`` and ``edp`` count packages."""
    wide = project_measures(m.projects(), _ties(m), _project_maintainability(m), references.package_references(_refs(m), m.projects()))
    return diff.project_diff(durable(wide), _pairs(m), diff.FURTHER_MEASURES)


_CHANGED = "NOT is_added AND NOT is_removed AND (mi_delta <> 0 OR total_cc_delta <> 0 OR total_loc_delta <> 0 OR warning_count_delta <> 0)"


@query("pr12_changed_projects", f"{_with(*_DIFF)}, {_J1} SELECT head AS head_snapshot_id, project, mi_delta, total_cc_delta, CASE WHEN total_cc_delta > 50 OR (base_total_cc > 0 AND total_cc_delta::DOUBLE / base_total_cc > 0.1) THEN 'bad_increase' ELSE 'neutral' END AS semantic, CASE WHEN warning_count_delta > 0 THEN '+' || warning_count_delta ELSE CAST(warning_count_delta AS VARCHAR) END AS warnings_shown FROM j WHERE {_CHANGED}")
def p12_changed_projects(m: Model) -> DataFrame:
    rows = diff.changed_projects(j1_project_diff(m))
    return rows.select("head_snapshot_id", "project", "mi_delta", "total_cc_delta", fn.complexity_semantic("total_cc_delta", "base_total_cc").alias("semantic"), fn.signed_delta("warning_count_delta").alias("warnings_shown"))


@query("t5_maintainability_order", f"{_with(*_DIFF)}, {_J1} SELECT head AS head_snapshot_id, project, mi_delta, CAST(row_number() OVER (PARTITION BY head ORDER BY abs(mi_delta) DESC, lower(project), project) AS INTEGER) AS rank_no FROM j WHERE {_CHANGED}")
def t5_maintainability_order(m: Model) -> DataFrame:
    w = Window.partitionBy("head_snapshot_id").orderBy(F.abs("mi_delta").desc(), F.lower("project"), "project")
    return diff.changed_projects(j1_project_diff(m)).select("head_snapshot_id", "project", "mi_delta", F.row_number().over(w).alias("rank_no"))


@query(
    "t12_largest_changes",
    f"""{_with(*_DIFF)}, {_J1} SELECT head AS head_snapshot_id, project, mi_delta, CAST(rn AS INTEGER) AS rank_no FROM (
        SELECT *, row_number() OVER (PARTITION BY head ORDER BY abs(mi_delta) DESC, project) AS rn FROM j WHERE NOT is_added AND NOT is_removed) WHERE rn <= 10""",
)
def t12_largest_changes(m: Model) -> DataFrame:
    both = j1_project_diff(m).where("not is_added and not is_removed")
    w = Window.partitionBy("head_snapshot_id").orderBy(F.abs("mi_delta").desc(), "project")
    return both.withColumn("rank_no", F.row_number().over(w)).where("rank_no <= 10").select("head_snapshot_id", "project", "mi_delta", "rank_no")


_TOT = diff.TOTALS[:-1]
_TOTALS_SQL = f"""x AS (SELECT snapshot_id, count(*) AS projects, sum(type_count) AS types, sum(method_count) AS methods, sum(total_cc) AS cc, sum(total_loc) AS loc FROM pr GROUP BY 1),
    y AS (SELECT snapshot_id, {_LEVELS} FROM d GROUP BY 1), v AS (SELECT snapshot_id, round_even(CAST(sum(CAST(mi AS DECIMAL(28,10))) AS DOUBLE) / count(mi) * 10, 0) / 10 AS avg_mi FROM m GROUP BY 1 HAVING count(mi) > 0),
    z AS (SELECT s.snapshot_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in _TOT)}, coalesce(avg_mi, 0.0::DOUBLE) AS avg_mi FROM s LEFT JOIN x USING (snapshot_id) LEFT JOIN y USING (snapshot_id) LEFT JOIN v USING (snapshot_id)),
    w AS (SELECT head AS head_snapshot_id, base AS base_snapshot_id, {', '.join(f'b.{c} AS base_{c}, h.{c} AS head_{c}, h.{c} - b.{c} AS {c}_delta' for c in _TOT)},
          b.avg_mi AS base_avg_mi, h.avg_mi AS head_avg_mi, round_even((h.avg_mi - b.avg_mi) * 10, 0) / 10 AS avg_mi_delta FROM pairs JOIN z b ON b.snapshot_id = base JOIN z h ON h.snapshot_id = head)"""


def _totals(m: Model) -> DataFrame:
    return diff.totals_diff(diff.snapshot_totals(m.projects(), m.methods(), m.diagnostics()), _pairs(m))


@query("a35_totals_diff", f"{_with('s', 'pairs', 'pr', 'd', 'm')}, {_TOTALS_SQL} SELECT * FROM w")
def a35_totals_diff(m: Model) -> DataFrame:
    return _totals(m)


_REFS = """refs AS (SELECT snapshot_id, from_entity AS project, min(to_entity) AS ref FROM e WHERE dep_type = 0 GROUP BY snapshot_id, from_entity, lower(to_entity)),
        sgn AS (SELECT head, project, ref, 1 AS g FROM pairs JOIN refs ON snapshot_id = head UNION ALL SELECT head, project, ref, -1 FROM pairs JOIN refs ON snapshot_id = base)"""
_FRESH = """srefs AS (SELECT snapshot_id, min(to_entity) AS ref FROM e WHERE dep_type = 0 GROUP BY snapshot_id, lower(to_entity)),
        ssgn AS (SELECT head, ref, 1 AS g FROM pairs JOIN srefs ON snapshot_id = head UNION ALL SELECT head, ref, -1 FROM pairs JOIN srefs ON snapshot_id = base),
        fresh AS (SELECT head, ref, sum(g) AS g FROM ssgn GROUP BY head, ref HAVING sum(g) <> 0)"""
#: References added to projects that both snapshots hold.
_ADDED = f"""{_REFS}, here AS (SELECT DISTINCT snapshot_id, lower(project_name) AS k FROM pr WHERE project_name IS NOT NULL UNION SELECT DISTINCT snapshot_id, lower(from_entity) FROM e WHERE dep_type = 0),
        added AS (SELECT c.* FROM (SELECT head, project, ref FROM sgn GROUP BY head, project, ref HAVING sum(g) > 0) c JOIN pairs USING (head)
                  JOIN here b ON b.snapshot_id = base AND b.k = lower(project) JOIN here h ON h.snapshot_id = head AND h.k = lower(project))"""


def _refs(m: Model) -> DataFrame:
    return m.edges().where("dep_type = 0").select("snapshot_id", F.col("from_entity").alias("project"), F.col("to_entity").alias("ref"))


def _added(m: Model) -> DataFrame:
    refs, pairs = durable(_refs(m)), _pairs(m)
    changes = diff.reference_changes(refs, pairs, ["project"]).where("outcome = 'added'")
    return references.of_both_snapshots(changes, references.present_projects(m.projects(), refs), pairs)


@query("u4_reference_changes", f"{_with('s', 'pairs', 'e')}, {_REFS} SELECT head AS head_snapshot_id, project, ref, CASE WHEN sum(g) > 0 THEN 'added' ELSE 'removed' END AS outcome FROM sgn GROUP BY head, project, ref HAVING sum(g) <> 0")
def u4_reference_changes(m: Model) -> DataFrame:
    return diff.reference_changes(_refs(m), _pairs(m), ["project"])


@query("u5_new_to_solution", f"{_with('s', 'pairs', 'e')}, {_FRESH} SELECT head AS head_snapshot_id, ref, CASE WHEN g > 0 THEN 'added' ELSE 'removed' END AS outcome FROM fresh")
def u5_new_to_solution(m: Model) -> DataFrame:
    """Of all references of a snapshot, to projects and packages alike."""
    return diff.reference_changes(_refs(m).drop("project"), _pairs(m))


@query(
    "u3_package_changes",
    f"""{_with('s', 'pairs', 'e', 'pr')}, {_PACKAGES}, sp AS (SELECT head, lower(project) AS k, ref, 1 AS g, min(project) AS p FROM pairs JOIN pk ON snapshot_id = head GROUP BY ALL
    UNION ALL SELECT head, lower(project), ref, -1, min(project) FROM pairs JOIN pk ON snapshot_id = base GROUP BY ALL)
    SELECT head AS head_snapshot_id, min(p) AS project, ref, CASE WHEN sum(g) > 0 THEN 'added' ELSE 'removed' END AS outcome, {_BCL.replace('x ', 'ref ')} AS is_bcl FROM sp GROUP BY head, k, ref HAVING sum(g) <> 0""",
)
def u3_package_changes(m: Model) -> DataFrame:
    return references.external_changes(references.package_references(_refs(m), m.projects()), _pairs(m))


@query(
    "t7_external_changes",
    f"""{_with('s', 'pairs', 'e', 'pr')}, {_PACKAGES}, here AS (SELECT DISTINCT snapshot_id, lower(project_name) AS k FROM pr WHERE project_name IS NOT NULL UNION SELECT DISTINCT snapshot_id, lower(from_entity) FROM e WHERE dep_type = 0),
    sp AS (SELECT head, base, lower(project) AS k, ref, 1 AS g, min(project) AS p FROM pairs JOIN pk ON snapshot_id = head GROUP BY ALL UNION ALL SELECT head, base, lower(project), ref, -1, min(project) FROM pairs JOIN pk ON snapshot_id = base GROUP BY ALL),
    ch AS (SELECT head, base, k, min(p) AS project, ref, sum(g) AS g FROM sp GROUP BY head, base, k, ref HAVING sum(g) <> 0),
    per AS (SELECT head, project, count(*) FILTER (g > 0 AND {_BCL.replace('x ', 'ref ')}) AS bcl_added, count(*) FILTER (g > 0 AND NOT {_BCL.replace('x ', 'ref ')}) AS packages_added, CAST(sum(g) AS BIGINT) AS external_delta
            FROM ch JOIN here b ON b.snapshot_id = base AND b.k = ch.k JOIN here h ON h.snapshot_id = head AND h.k = ch.k GROUP BY head, project)
    SELECT head AS head_snapshot_id, project, bcl_added, packages_added, external_delta, CAST(rn AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY abs(external_delta) DESC, lower(project), project) AS rn FROM per WHERE bcl_added + packages_added > 0) WHERE rn <= 10""",
)
def t7_external_changes(m: Model) -> DataFrame:
    """Projects with added packages, those whose number of packages changed most first."""
    refs, pairs = durable(_refs(m)), _pairs(m)
    changes = references.external_changes(references.package_references(refs, m.projects()), pairs)
    kept = references.of_both_snapshots(changes, references.present_projects(m.projects(), refs), pairs)
    new = F.col("outcome") == "added"
    per = kept.groupBy("head_snapshot_id", "project").agg(F.count_if(new & F.col("is_bcl")).alias("bcl_added"), F.count_if(new & ~F.col("is_bcl")).alias("packages_added"), F.sum(F.when(new, 1).otherwise(-1)).alias("external_delta"))
    w = Window.partitionBy("head_snapshot_id").orderBy(F.abs("external_delta").desc(), F.lower("project"), "project")
    return per.where("bcl_added + packages_added > 0").withColumn("rank_no", F.row_number().over(w)).where("rank_no <= 10")


@query(
    "t8_reference_summary",
    f"""{_with('s', 'pairs', 'e', 'pr')}, {_ADDED}, {_FRESH}, k AS (SELECT DISTINCT head, lower(ref) AS k FROM fresh WHERE g > 0),
    mk AS (SELECT a2.*, k.k IS NOT NULL AS is_new, '`' || replace(ref, '|', '\\|') || '`' || CASE WHEN k.k IS NOT NULL THEN ' 🆕' ELSE '' END AS shown FROM added a2 LEFT JOIN k ON k.head = a2.head AND k.k = lower(ref))
    SELECT head AS head_snapshot_id, project, count(*) FILTER ({_BCL.replace('x ', 'ref ')}) AS bcl_added, count(*) FILTER (NOT {_BCL.replace('x ', 'ref ')}) AS packages_added, count(*) FILTER (is_new) AS new_to_solution,
           array_to_string(list_slice(list(shown ORDER BY ref), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ', +' || (count(*) - 3) || ' more' ELSE '' END AS summary FROM mk GROUP BY head, project""",
)
def t8_reference_summary(m: Model) -> DataFrame:
    return diff.reference_summary(_added(m).withColumn("outcome", F.lit("added")), diff.reference_changes(_refs(m).drop("project"), _pairs(m)))


@query("a34_package_counts", f"{_with('e', 'pr')}, {_PACKAGES} SELECT snapshot_id, project AS n, ed, edb, edp FROM pkc")
def a34_package_counts(m: Model) -> DataFrame:
    return references.package_counts(references.package_references(_refs(m), m.projects()))


_D2 = f"""dx AS (SELECT head, lower(project) AS a, lower(id) AS b, severity, lower(message) AS c, lower(file) AS f, line, col_no, count(*) FILTER (snapshot_id = base) AS nb, count(*) FILTER (snapshot_id = head) AS nh
                FROM pairs JOIN d ON snapshot_id IN (base, head) WHERE pos IS NOT NULL GROUP BY ALL),
        dl AS (SELECT head, severity, sum(greatest(nb - nh, 0)) AS lb, sum(greatest(nh - nb, 0)) AS lh FROM dx GROUP BY head, a, b, severity, c, f),
        dc AS (SELECT head, {', '.join(f"CAST(coalesce(sum({x}) FILTER (severity = {k}), 0) AS BIGINT) AS {o}_{n}" for o, x in (('added', 'lh - least(lb, lh)'), ('removed', 'lb - least(lb, lh)'), ('changed', 'least(lb, lh)')) for k, n in enumerate(('hidden', 'info', 'warning', 'error')))}
               FROM dl GROUP BY head HAVING sum(lb + lh) > 0)"""


def _diagnostic_counts(m: Model) -> DataFrame:
    pairs = _pairs(m)
    changes = snapshot_diff.diagnostic_changes(m.diagnostics(), snapshot_roles(pairs))
    return diff.diagnostic_counts(changes.join(pairs.withColumnRenamed("head_snapshot_id", "pair"), "pair"), m.diagnostics())


@query("d2_diagnostic_counts", f"{_with('s', 'pairs', 'd')}, {_D2} SELECT head AS head_snapshot_id, * EXCLUDE (head) FROM dc")
def d2_diagnostic_counts(m: Model) -> DataFrame:
    return _diagnostic_counts(m)


_META = ", ".join(f"{x}.{c} AS {side}_{c}" for side, x in (("base", "b"), ("head", "h")) for c in diff.METADATA)


@query("pr19_diff_metadata", f"{_with('s', 'pairs')} SELECT head AS head_snapshot_id, base AS base_snapshot_id, {_META}, coalesce(lower(b.analysis_mode) = 'full', false) AND coalesce(lower(h.analysis_mode) = 'full', false) AS has_complexity FROM pairs JOIN s b ON b.snapshot_id = base JOIN s h ON h.snapshot_id = head")
def p19_diff_metadata(m: Model) -> DataFrame:
    return diff.diff_metadata(m.snapshots(), _pairs(m))


_COMPARED = ["projects_delta", "cc_delta", "avg_mi_delta", "errors_delta", "projects_added", "projects_removed", "projects_changed", "new_to_solution", "removed_from_solution", *[f"{o}_{n}" for o in ("added", "removed", "changed") for n in ("info", "warning", "error")]]


def _compared(m: Model) -> DataFrame:
    presence = diff.reference_changes(_refs(m).drop("project"), _pairs(m))
    return diff.compare(diff.diff_metadata(m.snapshots(), _pairs(m)), _totals(m), durable(j1_project_diff(m)), _diagnostic_counts(m), presence)


@query(
    "d1_compare",
    f"""{_with('s', 'pairs', 'm', 't', 'pt', 'pr', 'e', 'a', 'd')}, {_J1}, {_TOTALS_SQL}, {_FRESH}, {_D2},
    jc AS (SELECT head, count(*) FILTER (is_added) AS projects_added, count(*) FILTER (is_removed) AS projects_removed, count(*) FILTER ({_CHANGED}) AS projects_changed FROM j GROUP BY 1),
    fc AS (SELECT head, count(*) FILTER (g > 0) AS new_to_solution, count(*) FILTER (g < 0) AS removed_from_solution FROM fresh GROUP BY 1)
    SELECT w.head_snapshot_id, w.base_snapshot_id, coalesce(lower(b.analysis_mode) = 'full', false) AND coalesce(lower(h.analysis_mode) = 'full', false) AS has_complexity,
           {', '.join(c if c.endswith('_delta') else f'coalesce({c}, 0) AS {c}' for c in _COMPARED)}
    FROM w JOIN s b ON b.snapshot_id = base_snapshot_id JOIN s h ON h.snapshot_id = head_snapshot_id LEFT JOIN jc ON jc.head = head_snapshot_id LEFT JOIN fc ON fc.head = head_snapshot_id LEFT JOIN dc ON dc.head = head_snapshot_id""",
)
def d1_compare(m: Model) -> DataFrame:
    return _compared(m).select("head_snapshot_id", "base_snapshot_id", "has_complexity", *_COMPARED)


@query("a25_average_maintainability", f"{_with('m')} SELECT snapshot_id, coalesce(round_even(CAST(sum(CAST(mi AS DECIMAL(28,10))) AS DOUBLE) / nullif(count(mi), 0) * 10, 0) / 10, 0.0::DOUBLE) AS avg_mi FROM m GROUP BY 1")
def a25_average_maintainability(m: Model) -> DataFrame:
    return diff.average_maintainability(m.methods())


# ---- tokens, inheritance, streams, documents

_OPS = ", ".join("'" + t + "'" for t in OPERATOR_SYMBOLS + OPERATOR_WORDS)
_PASSIVE = ", ".join("'" + t + "'" for t in RESERVED if t not in OPERAND_WORDS)
_TOKENS = PATTERN.replace("'", "''")


@query(
    "a39_halstead",
    f"""WITH k AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_TOKENS}', 0) AS t FROM documents),
    o AS (SELECT doc_id, list_filter(t, lambda x: list_contains([{_OPS}], x)) AS a, list_filter(t, lambda x: (regexp_matches(x[1], '[A-Za-z_0-9"'']') AND x[1:3] <> repeat('"', 3) OR x[1:2] = '@"') AND NOT list_contains([{_OPS}], x) AND NOT list_contains([{_PASSIVE}], x)) AS b FROM k),
    c AS (SELECT doc_id, CAST(len(list_distinct(a)) AS INTEGER) AS n1, CAST(len(list_distinct(b)) AS INTEGER) AS n2, CAST(len(a) AS INTEGER) AS total1, CAST(len(b) AS INTEGER) AS total2 FROM o),
    v AS (SELECT *, CASE WHEN total1 + total2 > 0 AND n1 + n2 > 1 THEN (total1 + total2) * log2(n1 + n2) ELSE 0 END AS v, CASE WHEN n2 > 0 THEN (n1 / 2.0::DOUBLE) * (total2::DOUBLE / n2) ELSE 0 END AS d FROM c)
    SELECT doc_id, n1, n2, total1, total2, round_even(v * 100, 0) / 100 AS volume, round_even(d * 100, 0) / 100 AS difficulty, round_even(v * d, 0) AS effort FROM v""",
)
def a39_halstead(m: Model) -> DataFrame:
    rows = halstead(table(m.spark, m.folder, "documents"), "text", ["doc_id"])
    return _rounded(_rounded(rows, "effort", digits=0), "volume", "difficulty", digits=2)


@query(
    "f9_inheritance",
    """WITH RECURSIVE b AS (SELECT p_partkey AS k, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS base FROM part),
    c(k, up, depth) AS (SELECT k, base, CASE WHEN base IS NULL THEN 0 ELSE 1 END FROM b UNION ALL SELECT c.k, b.base, c.depth + 1 FROM c JOIN b ON c.up = b.k WHERE b.base IS NOT NULL)
    SELECT CAST(k AS VARCHAR) AS name, CAST(max(depth) AS INTEGER) AS depth FROM c GROUP BY 1""",
)
def f9_inheritance(m: Model) -> DataFrame:
    parts = table(m.spark, m.folder, "part").select(F.col("p_partkey").cast("string").alias("k"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10).cast("string")).alias("base"))
    return depth_of_inheritance(parts, "k", "base")


@query("st1_streamed_edges", f"{_with('e')} SELECT snapshot_id, from_entity, to_entity, dep_type, CAST(sum(n) AS BIGINT) AS reference_count, count(*) AS times_added FROM e GROUP BY ALL")
def st1_streamed_edges(m: Model) -> DataFrame:
    batch = table(m.spark, m.folder, "dependencies")
    path = f"{m.folder.rstrip('/')}/dependencies.parquet"
    one_file = len(files := batch.inputFiles()) == 1 and files[0].endswith("/dependencies.parquet")
    stream = edge_stream(m.spark, m.folder if one_file else path, batch.schema, "dependencies.parquet" if one_file else None)
    return drain(stream)


def _project_maintainability(m: Model) -> DataFrame:
    return rollup.project_rollup(rollup.type_rollup(m.types(), m.methods()))


def _ties(m: Model) -> DataFrame:
    return coupling.project_coupling(m.edges(), m.projects())


def _compact_projects(m: Model) -> DataFrame:
    packages = references.package_references(_refs(m), m.projects())
    return compact_projects(m.projects(), _ties(m), _project_maintainability(m), a31_diagnostics_per_project(m), packages)


_COMPACT = f"""g0 AS (SELECT snapshot_id, project, {_LEVELS} FROM d GROUP BY 1, 2),
    kp AS (SELECT pw.snapshot_id, project_name AS n, coalesce(type_count, 0) AS tc, coalesce(method_count, 0) AS mc, coalesce(total_cc, 0) AS cc, coalesce(total_loc, 0) AS loc, coalesce(max_dit, 0) AS dit,
           mi, id, idx, dr, packages AS ed, edb, edp, nullif(errors, 0) AS err, nullif(warnings, 0) AS warn
    FROM pw LEFT JOIN g0 ON g0.snapshot_id = pw.snapshot_id AND g0.project = project_name WHERE project_name IS NOT NULL)"""
_COMPACT_OF = f"{_with('m', 't', 'pt', 'pr', 'e', 'a', 'd')}, {_WIDE}, {_COMPACT}"


@query("k2_compact_projects", f"{_COMPACT_OF} SELECT * FROM kp")
def k2_compact_projects(m: Model) -> DataFrame:
    return _compact_projects(m)


@query("a44_dependency_totals", f"{_COMPACT_OF} SELECT snapshot_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('id', 'ed', 'edb', 'edp'))}, bool_or(ed > 0) AS any_external FROM kp GROUP BY 1")
def a44_dependency_totals(m: Model) -> DataFrame:
    return _compact_projects(m).groupBy("snapshot_id").agg(*[F.sum(c).alias(c) for c in ("id", "ed", "edb", "edp")], F.bool_or(F.col("ed") > 0).alias("any_external"))


@query("j4_project_summary", f"{_COMPACT_OF} SELECT snapshot_id, n, cc, id, idx, dr FROM kp WHERE cc > 0")
def j4_project_summary(m: Model) -> DataFrame:
    ties = coupling.project_coupling(m.edges(), m.projects()).select("snapshot_id", F.col("entity").alias("n"), "id", "idx", fn.round_even("dr", 2).alias("dr"))
    own = m.projects().where("project_name is not null and total_cc > 0").select("snapshot_id", F.col("project_name").alias("n"), F.col("total_cc").alias("cc"))
    return own.join(ties, ["snapshot_id", "n"], "left").na.fill(0, ["id", "idx"]).na.fill(0.0, ["dr"])


def _graphs(m: Model) -> DataFrame:
    projects, spaces = durable(_project_nodes(m)), durable(g5_namespace_nodes(m))
    return graphs_of_layers(
        graph_document(projects, coupling.graph_edges(m.edges(), projects, coupling.PROJECT, loops=True), ["node_id", "name", "loc"]),
        graph_document(spaces, coupling.graph_edges(m.edges(), spaces, coupling.NAMESPACE, loops=False), ["node_id", "name", "loc", "cc", "mi", "tc", "mc", "id", "idx", "dr", "ed"]),
    )


@query("k2_compact_reports")
def k2_compact_reports(m: Model) -> DataFrame:
    return compact_reports(m.snapshots(), _compact_projects(m), _graphs(m), m.diagnostics())


@query("k3_hierarchical_reports")
def k3_hierarchical_reports(m: Model) -> DataFrame:
    return hierarchical_reports(m.types(), m.methods())


@query("k2_graph_layers")
def k2_graph_layers(m: Model) -> DataFrame:
    return _graphs(m)


@query(
    "a42_viewer_totals",
    f"{_with('pr')} SELECT snapshot_id, CAST(coalesce(sum(error_count), 0) AS BIGINT) AS errors, CAST(coalesce(sum(warning_count), 0) AS BIGINT) AS warnings, CAST(coalesce(sum(total_cc), 0) AS BIGINT) AS cc, CAST(coalesce(sum(total_loc), 0) AS BIGINT) AS loc, CAST(coalesce(sum(type_count), 0) AS BIGINT) AS types, CAST(coalesce(sum(method_count), 0) AS BIGINT) AS methods, CAST(coalesce(sum(coalesce(error_count, 0) * 5 + coalesce(warning_count, 0)), 0) AS BIGINT) AS score FROM pr GROUP BY 1",
)
def a42_viewer_totals(m: Model) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    sums = {"errors": "error_count", "warnings": "warning_count", "cc": "total_cc", "loc": "total_loc", "types": "type_count", "methods": "method_count"}
    return m.projects().groupBy("snapshot_id").agg(*[F.coalesce(F.sum(c).cast("bigint"), zero).alias(n) for n, c in sums.items()], F.coalesce(F.sum(fn.diagnostics_score("error_count", "warning_count")).cast("bigint"), zero).alias("score"))


@query(
    "f33_heat_colours",
    f"""{_with('pr')}, w AS (SELECT snapshot_id, project_row_id, coalesce(total_cc, 0)::DOUBLE AS v FROM pr), r AS (SELECT *, CASE WHEN max(v) OVER p > min(v) OVER p THEN (v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) ELSE 0 END AS q FROM w WINDOW p AS (PARTITION BY snapshot_id)),
    z AS (SELECT *, CASE WHEN q < 0.5 THEN q * 2 ELSE (q - 0.5) * 2 END AS t FROM r)
    SELECT snapshot_id, project_row_id, 'rgb(' || CAST(floor(CASE WHEN q < 0.5 THEN 168 + t * 72 ELSE 240 - t * 8 END + 0.5) AS BIGINT) || ', ' || CAST(floor(CASE WHEN q < 0.5 THEN 213 + t * 17 ELSE 230 - t * 46 END + 0.5) AS BIGINT) || ', ' || CAST(floor(CASE WHEN q < 0.5 THEN 186 - t * 2 ELSE 184 + t * 0 END + 0.5) AS BIGINT) || ')' AS colour FROM z""",
)
def f33_heat_colours(m: Model) -> DataFrame:
    rows = m.projects().select("snapshot_id", "project_row_id", F.coalesce("total_cc", F.lit(0)).cast("double").alias("v"))
    return rows.select("snapshot_id", "project_row_id", fn.heat_colour(coupling.min_max("v", ["snapshot_id"])).alias("colour"))


@query("sf_source_facts")
def sf_source_facts(m: Model) -> DataFrame:
    """The C# front end over the code blocks of documents, each wrapped in a type so that it has members."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?is)```csharp\s(.*?)```"), 1)
    rows = table(m.spark, m.folder, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".cs")).alias("path"), F.explode(blocks).alias("code"))
    return source_facts(rows.withColumn("content", F.concat(F.lit("class Snippet {\n"), "code", F.lit("\n}"))))
