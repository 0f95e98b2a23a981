"""Queries over sources, sinks and the viewer's measures. What no table holds as a file is written in the engine first and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import metrics as fn
from plumbline.operators import coupling, references, rollup
from plumbline.operators.strict_json import unreadable
from plumbline.plans import analysis_queries as base
from plumbline.session import durable
from plumbline.sources import files, frontend, reports
from plumbline.sources.model import Model
from plumbline.sources.tables import table

_with, query = base._with, base.query


def _xml(text: Column | str) -> Column:
    out = fn.col(text)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


# ---- solutions, projects and source text


@query(
    "s1_solution_projects",
    f"""{_with('s', 'pr')} SELECT DISTINCT snapshot_id || CASE WHEN lower(solution_path) LIKE '%.slnx' THEN '.slnx' ELSE '.sln' END AS path,
    CASE WHEN lower(solution_path) LIKE '%.slnx' THEN regexp_replace(split_part(file_path, '/', -1), '\\.[^.]*$', '') ELSE project_name END AS project_name, file_path AS project_path
    FROM s JOIN pr USING (snapshot_id) WHERE project_name IS NOT NULL AND lower(file_path) LIKE '%.csproj'""",
)
def s1_solution_projects(m: Model) -> DataFrame:
    """Solution files of both formats, written from the projects of each snapshot and read by the scan."""
    xml = F.lower("solution_path").endswith(".slnx")
    entry = F.when(xml, F.concat(F.lit('  <Project Path="'), _xml("file_path"), F.lit('" />'))).otherwise(F.concat(F.lit('Project("{9A19103F}") = "'), F.col("project_name"), F.lit('", "'), F.col("file_path"), F.lit('", "{0}"\nEndProject')))
    rows = m.snapshots().join(m.projects().select("snapshot_id", "project_name", "file_path").where("project_name is not null and file_path is not null"), "snapshot_id")
    other = F.when(xml, '  <Project Path="x/Other.vbproj" />').otherwise('Project("{F184B08F}") = "Other", "x/Other.vbproj", "{1}"\nEndProject')
    texts = rows.groupBy("snapshot_id", xml.alias("xml")).agg(F.array_join(F.collect_list(entry), "\n").alias("body"), F.max(other).alias("other"))
    body = F.concat("body", F.lit("\n"), "other")
    content = F.when(F.col("xml"), F.concat(F.lit("<Solution>\n"), body, F.lit("\n</Solution>"))).otherwise(body)
    return files.solution_projects(texts.select(F.concat("snapshot_id", F.when(F.col("xml"), ".slnx").otherwise(".sln")).alias("path"), content.alias("content")))


@query(
    "s6_project_edges",
    f"""{_with('e')}, own AS (SELECT DISTINCT snapshot_id, from_entity FROM e WHERE dep_type = 0), k AS (SELECT snapshot_id, lower(from_entity) AS k, min(from_entity) AS name FROM own GROUP BY 1, 2),
    r AS (SELECT snapshot_id, from_entity, lower(to_entity) AS k, min(to_entity) AS ref FROM e WHERE dep_type = 0 GROUP BY 1, 2, 3)
    SELECT r.snapshot_id, from_entity, coalesce(name, ref) AS to_entity, 0 AS dep_type, CAST(1 AS BIGINT) AS reference_count FROM r LEFT JOIN k USING (snapshot_id, k)""",
)
def s6_project_edges(m: Model) -> DataFrame:
    """Project files written from the references of each project, read, resolved against the others and made edges."""
    place = lambda name: F.concat(F.lit("/"), F.col("snapshot_id"), F.lit("/src/"), F.col(name), F.lit("/"), F.col(name), F.lit(".csproj"))
    refs = m.edges().where("dep_type = 0").select("snapshot_id", "from_entity", "to_entity").distinct()
    item = F.concat(F.lit('<ProjectReference Include=" ..\\'), _xml("to_entity"), F.lit("\\"), _xml("to_entity"), F.lit('.csproj "/>'))
    written = refs.groupBy("snapshot_id", "from_entity").agg(F.array_join(F.collect_list(item), "\n").alias("body"))
    texts = durable(written.select(place("from_entity").alias("path"), F.concat(F.lit("<Project><ItemGroup>"), "body", F.lit('<PackageReference Include="A.B"/></ItemGroup></Project>')).alias("content"), F.col("from_entity").alias("project_name"), "snapshot_id"))
    edges = files.project_edges(texts.select("path", "content"), texts.select("path", "project_name"))
    return edges.join(texts.select("path", "snapshot_id"), "path").select("snapshot_id", "from_entity", "to_entity", "dep_type", "reference_count")


@query(
    "g1_reference_edges",
    """WITH p AS (SELECT p_partkey AS k, greatest(1, p_partkey // 2) AS j FROM part), x AS (SELECT 'N' || k % 40 || '.S' AS fs, 'N' || j % 40 || '.S' AS ts, 'T' || k AS f, 'T' || j AS t, k = j AS same FROM p)
    SELECT fs || '.' || f AS from_entity, ts || '.' || t AS to_entity, 3 AS dep_type, CAST(2 AS BIGINT) AS reference_count FROM x WHERE NOT same
    UNION ALL SELECT fs, ts, 2, CAST(3 * count(*) AS BIGINT) FROM x WHERE fs <> ts GROUP BY 1, 2""",
)
def g1_reference_edges(m: Model) -> DataFrame:
    """Source text of one type per part, which uses the type of another part twice and opens its namespace."""
    part = table(m.spark, m.folder, "part").select(F.col("p_partkey").alias("k"), F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("p_partkey") / 2)).alias("j"))
    text = F.format_string("using N%d.S;\n// uses T%d\nnamespace N%d.S;\nclass T%d\n{\n    T%d field;\n    void M(int x) { var y = new T%d(x, \"T1\"); }\n}\n", F.col("j") % 40, F.col("j"), F.col("k") % 40, F.col("k"), F.col("j"), F.col("j"))
    facts = durable(frontend.source_facts(part.select(F.concat(F.col("k").cast("string"), F.lit(".cs")).alias("path"), text.alias("content"))))
    return frontend.reference_edges(facts)


@query(
    "f2_measured_bodies",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS a, p_partkey % 3 AS b, p_partkey % 2 AS c, p_partkey % 4 AS d FROM part)
    SELECT k || '.cs' AS file_path, CAST(2 + a + 2 * b + c + CASE WHEN d > 0 THEN d + 1 ELSE 0 END AS INTEGER) AS complexity, CAST(1 + 2 * a + 2 * b + 3 * c + CASE WHEN d > 0 THEN d + 2 ELSE 0 END AS INTEGER) AS lines FROM p""",
)
def f2_measured_bodies(m: Model) -> DataFrame:
    """Bodies of known branches and statements, as many of each as a part's key says, written as source text and measured."""
    k = F.col("p_partkey")
    times = lambda text, n: F.repeat(F.lit(text), (k % n).cast("int"))
    labels = F.array_join(F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda i: F.concat(F.lit("case "), i.cast("string"), F.lit(": break; "))), "")
    switch = F.when(k % 4 > 0, F.concat(F.lit("switch (n) { "), labels, F.lit("default: break; }\n"))).otherwise("")
    body = F.concat(times("if (n > 1) { n = 2; }\n", 5), times("while (n > 0 && ok) { Step(); }\n", 3), times("try { Go(); } catch { Stop(); }\n", 2), switch, F.lit("// if (no)\nreturn a ?? b;\n"))
    text = F.concat(F.lit("class C\n{\n[Old(\"if\")] public int M(int n)\n{\n"), body, F.lit("}\n}\n"))
    facts = frontend.source_facts(table(m.spark, m.folder, "part").select(F.concat(k.cast("string"), F.lit(".cs")).alias("path"), text.alias("content")))
    return facts.where("kind = 'method'").select("file_path", "complexity", "lines")


_SPACE = lambda c: f"CASE WHEN length({c}) - length(split_part({c}, '.', -1)) > 1 THEN substring({c}, 1, length({c}) - length(split_part({c}, '.', -1)) - 1) ELSE '' END"


@query(
    "g2_derived_namespace_edges",
    f"""{_with('e', 'a')}, x AS (SELECT snapshot_id, {_SPACE('from_entity')} AS f, {_SPACE('to_entity')} AS t, n FROM a WHERE dep_type = 3)
    SELECT snapshot_id, f AS from_entity, t AS to_entity, 2 AS dep_type, CAST(sum(n) AS BIGINT) AS reference_count FROM x WHERE f <> t AND t <> '' GROUP BY ALL""",
)
def g2_derived_namespace_edges(m: Model) -> DataFrame:
    return coupling.derived_namespace_edges(m.edges())


# ---- graph layers over the ends of edges


def _layer_sql(kind: int, loops: bool) -> str:
    return f"""{_with('e', 'a')}, nn AS (SELECT snapshot_id, x AS name, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY x) - 1 AS INTEGER) AS node_id FROM (SELECT DISTINCT snapshot_id, from_entity AS x FROM a WHERE dep_type = {kind})),
    ge AS (SELECT a.snapshot_id, f.node_id AS source, t.node_id AS target, CAST(sum(n) AS BIGINT) AS weight FROM a JOIN nn f ON f.snapshot_id = a.snapshot_id AND f.name = from_entity
           JOIN nn t ON t.snapshot_id = a.snapshot_id AND t.name = to_entity WHERE dep_type = {kind}{'' if loops else ' AND from_entity <> to_entity'} GROUP BY 1, 2, 3)"""


def _layer(m: Model, kind: int, loops: bool) -> DataFrame:
    edges = coupling.aggregated(m.edges())
    return coupling.graph_edges(edges, durable(coupling.entity_nodes(edges, kind)), kind, loops)


@query("g5_entity_edges", f"{_layer_sql(2, False)} SELECT * FROM ge")
def g5_entity_edges(m: Model) -> DataFrame:
    return _layer(m, coupling.NAMESPACE, False)


@query("g4_entity_edges", f"{_layer_sql(3, True)} SELECT * FROM ge")
def g4_entity_edges(m: Model) -> DataFrame:
    """The layer that keeps its loops, over the ends of type edges."""
    return _layer(m, coupling.TYPE, True)


@query("g6_entity_out_weight", f"{_layer_sql(2, False)} SELECT snapshot_id, source AS node_id, CAST(sum(weight) AS BIGINT) AS dep_count FROM ge GROUP BY 1, 2")
def g6_entity_out_weight(m: Model) -> DataFrame:
    return coupling.out_weights(_layer(m, coupling.NAMESPACE, False))


# ---- reports, written and read back


@query(
    "k1_full_reports",
    f"""{_with('s', 'm', 't')} SELECT s.snapshot_id, t.project, t.full_name AS type_name, m.full_name AS method_name, m.cc, m.loc, m.mi FROM m JOIN t ON t.type_id = m.type_id JOIN s ON s.snapshot_id = t.snapshot_id""",
)
def k1_full_reports(m: Model) -> DataFrame:
    """Every method of every full report, read back from its JSON text."""
    refs = base._refs(m)
    packages = references.package_references(refs, m.projects())
    own = refs.distinct().join(packages, ["snapshot_id", "project", "ref"], "left_anti")
    written = durable(reports.full_reports(m.snapshots(), m.projects(), m.types(), m.methods(), m.diagnostics(), packages, own))
    read = files.parsed_reports(written.select(F.col("snapshot_id").alias("path"), F.col("report").alias("content")))
    return files.report_methods(read).select(F.col("path").alias("snapshot_id"), "project", "type_name", F.col("fullName").alias("method_name"), F.col("cyclomaticComplexity").alias("cc"), F.col("linesOfExecutableCode").alias("loc"), F.col("maintainabilityIndex").alias("mi"))


@query(
    "k2_report_contents",
    f"""{base._COMPACT_OF}, s AS (SELECT * FROM snapshots QUALIFY snapshot_id IS NULL OR row_number() OVER (PARTITION BY snapshot_id ORDER BY loaded_at DESC) = 1),
    dd AS (SELECT snapshot_id, count(*) AS k, count(*) FILTER (severity = 3) AS e, count(*) FILTER (severity = 2) AS w, count(*) FILTER (severity = 1) AS i FROM d GROUP BY 1),
    pp AS (SELECT snapshot_id, count(*) AS k, CAST(sum(cc) AS BIGINT) AS cc, CAST(sum(ed) AS BIGINT) AS ed FROM kp GROUP BY 1)
    SELECT s.snapshot_id, solution_path AS p, epoch_us(analyzed_at) // 1000 AS t, coalesce(pp.k, 0) AS projects, coalesce(cc, 0) AS cc, coalesce(ed, 0) AS ed, coalesce(dd.k, 0) AS diagnostics, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(i, 0) AS info, coalesce(pp.k, 0) AS nodes
    FROM s LEFT JOIN pp USING (snapshot_id) LEFT JOIN dd USING (snapshot_id)""",
)
def k2_report_contents(m: Model) -> DataFrame:
    """What the compact reports say, read back from their JSON text."""
    shape = "p string, t bigint, prj array<struct<cc: bigint, ed: bigint>>, g struct<p: struct<n: array<string>>>, diag struct<e: bigint, w: bigint, i: bigint, d: array<string>>"
    written = durable(reports.compact_reports(m.snapshots(), base._compact_projects(m), base._graphs(m), m.diagnostics()))
    r = written.select("snapshot_id", F.from_json("report", shape).alias("r")).select("snapshot_id", "r.*")
    total = lambda c: F.aggregate("prj", F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x[c], F.lit(0)))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return r.select("snapshot_id", "p", "t", size("prj").alias("projects"), total("cc").alias("cc"), total("ed").alias("ed"), size("diag.d").alias("diagnostics"), zero("diag.e").alias("errors"), zero("diag.w").alias("warnings"), zero("diag.i").alias("info"), size("g.p.n").alias("nodes"))


@query(
    "k3_hierarchy_rows",
    f"""{_with('m', 't', 'pt')} SELECT snapshot_id, project, namespace AS n, count(*) AS tc, CAST(sum(k) AS BIGINT) AS mc, CAST(sum(cc) AS BIGINT) AS cc, CAST(sum(loc) AS BIGINT) AS loc, coalesce(max(dit), 0) AS dit,
    round_even(CASE WHEN sum(min_) > 0 THEN CAST(sum(mis) AS DOUBLE) / sum(min_) ELSE 0 END * 10, 0) / 10 AS mi, CAST(count(*) AS BIGINT) AS types_listed, CAST(sum(k) AS BIGINT) AS methods_listed FROM pt GROUP BY 1, 2, 3""",
)
def k3_hierarchy_rows(m: Model) -> DataFrame:
    """The namespaces of the hierarchical reports, read back from their JSON text, with what they list."""
    shape = "ns array<struct<n: string, tc: bigint, mc: bigint, cc: bigint, loc: bigint, dit: int, mi: double, types: array<struct<m: array<string>>>>>"
    written = durable(reports.hierarchical_reports(m.types(), m.methods()))
    r = written.select("snapshot_id", "project", F.inline(F.from_json("body", shape)["ns"]))
    listed = F.aggregate("types", F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(F.when(x["m"].isNotNull(), F.size(x["m"])), F.lit(0)))
    return r.select("snapshot_id", "project", "n", "tc", "mc", "cc", "loc", "dit", "mi", F.size("types").cast("bigint").alias("types_listed"), listed.alias("methods_listed"))


_BAD = """w AS (SELECT report_id, feed, CASE WHEN trim(payload, ' ' || chr(9) || chr(10) || chr(13)) = '' OR payload IS NULL THEN 'missing' WHEN NOT json_valid(payload) THEN 'unreadable' ELSE 'no object' END AS reason
        FROM (SELECT *, CASE WHEN json_valid(payload) THEN json_type(CASE WHEN json_valid(payload) THEN payload END) END AS k FROM compact_reports) WHERE k IS DISTINCT FROM 'OBJECT')"""


@query("s13_unreadable_reports", f"WITH {_BAD} SELECT report_id, reason FROM w")
def s13_unreadable_reports(m: Model) -> DataFrame:
    """The warnings of the scan of raw reports: each payload that gives no rows, and why."""
    return unreadable(table(m.spark, m.folder, "compact_reports"), "report_id", "payload").select("report_id", "reason")


@query("a41_first_warnings", f"WITH {_BAD} SELECT report_id, reason, greatest((SELECT count(*) FROM w) - 10, 0) AS more FROM w ORDER BY report_id LIMIT 10")
def a41_first_warnings(m: Model) -> DataFrame:
    return rollup.overflow(s13_unreadable_reports(m), [F.asc("report_id")], 10)


# ---- projections, orders and the viewer


@query("pr3_diagnostic_projection", f"{_with('d')} SELECT snapshot_id, pos, id, message, CASE severity WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 3 THEN 'error' ELSE 'hidden' END AS severity, file, line + 1 AS line, col_no + 1 AS col_no, category, help_link FROM d")
def p3_diagnostic_projection(m: Model) -> DataFrame:
    """Positions counted from 0 shown from 1."""
    return m.diagnostics().select("snapshot_id", "pos", "id", "message", fn.severity_label("severity").alias("severity"), "file", fn.one_based(F.col("line")).alias("line"), fn.one_based(F.col("col_no")).alias("col_no"), "category", "help_link")


@query("t2_project_order", f"{_with('pr')} SELECT snapshot_id, project_row_id, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY upper(project_name), project_name, project_row_id) AS INTEGER) AS place FROM pr WHERE project_name IS NOT NULL")
def t2_project_order(m: Model) -> DataFrame:
    w = Window.partitionBy("snapshot_id").orderBy(F.upper("project_name"), "project_name", "project_row_id")
    return m.projects().where("project_name is not null").select("snapshot_id", "project_row_id", F.row_number().over(w).alias("place"))


@query("w2_listed_ids", f"{_with('pr')} SELECT snapshot_id, project_row_id, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY project_row_id) - 1 AS INTEGER) AS node_id FROM pr")
def w2_listed_ids(m: Model) -> DataFrame:
    """Node ids in the order in which a snapshot lists its projects."""
    return coupling.numbered(m.projects().select("snapshot_id", "project_row_id"), "project_row_id")


@query("f17_dates", f"{_with('s')} SELECT snapshot_id, strftime(analyzed_at, '%Y-%m-%d %H:%M:%S UTC') AS shown, strftime(analyzed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(analyzed_at, '%Y-%m-%d-%H%M%S') AS file_part FROM s")
def f17_dates(m: Model) -> DataFrame:
    at = F.col("analyzed_at").cast("timestamp")
    forms = {"shown": "yyyy-MM-dd HH:mm:ss 'UTC'", "iso": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "file_part": "yyyy-MM-dd-HHmmss"}
    return m.snapshots().select("snapshot_id", *[F.date_format(at, f).alias(n) for n, f in forms.items()])


@query("f37_modes", f"{_with('s')} SELECT snapshot_id, CASE lower(trim(analysis_mode)) WHEN 'full' THEN 0 WHEN 'diagnosticsandreferences' THEN 1 END AS mode FROM s")
def f37_modes(m: Model) -> DataFrame:
    """The number of a mode by its name in any case; null where it names none."""
    pairs = [F.lit(x) for kv in reports.MODES.items() for x in kv]
    return m.snapshots().select("snapshot_id", F.element_at(F.create_map(*pairs), F.lower(F.trim("analysis_mode"))).alias("mode"))


@query("a46_average_radius", f"{_with('pr')}, {base._PNODES}, w AS (SELECT *, least(min(loc) OVER (PARTITION BY snapshot_id), 0) AS lo, greatest(max(loc) OVER (PARTITION BY snapshot_id), 1) AS hi FROM pn) SELECT snapshot_id, round_even(avg(15 + (loc - lo)::DOUBLE / (hi - lo) * 185) * 100, 0) / 100 AS radius FROM w GROUP BY 1")
def a46_average_radius(m: Model) -> DataFrame:
    nodes = base._project_nodes(m).withColumn("loc", F.col("loc").cast("double")).select("snapshot_id", coupling.radius("loc", ["snapshot_id"]).alias("r"))
    return nodes.groupBy("snapshot_id").agg(fn.round_even(F.avg("r"), 2).alias("radius"))


@query("j18_node_projects", f"{base._COMPACT_OF}, {base._PNODES} SELECT pn.snapshot_id, node_id, name, coalesce(err, 0) AS err, coalesce(warn, 0) AS warn, ed, mi FROM pn JOIN kp ON kp.snapshot_id = pn.snapshot_id AND n = name")
def j18_node_projects(m: Model) -> DataFrame:
    """The project of each node of the project layer."""
    own = base._compact_projects(m).select(F.col("snapshot_id").alias("_s"), "n", "err", "warn", "ed", "mi")
    joined = base._project_nodes(m).join(own, (F.col("snapshot_id") == F.col("_s")) & (F.col("name") == F.col("n")), "left")
    return joined.na.fill(0, ["err", "warn"]).select("snapshot_id", "node_id", "name", "err", "warn", "ed", "mi")


_MEASURES = {"coupling": "id", "external-deps": "ed", "complexity": "cc", "loc": "loc", "diagnostics": "coalesce(err, 0) * 5 + coalesce(warn, 0)", "bcl-deps": "edb", "package-deps": "edp", "maintainability": "100 - coalesce(nullif(mi, 0), 100)", "other": "7"}


@query("f36_node_measures", f"{base._COMPACT_OF} SELECT snapshot_id, n, " + ", ".join(f'coalesce({x}, 0)::DOUBLE AS "{k}"' for k, x in _MEASURES.items()) + " FROM kp")
def f36_node_measures(m: Model) -> DataFrame:
    rows = base._compact_projects(m).withColumn("dep_count", F.lit(7))
    return rows.select("snapshot_id", "n", *[fn.node_measure(name, "project").alias(name) for name in _MEASURES])


def load() -> None:
    """The queries of this module register themselves with those of the analytics when it is imported."""
