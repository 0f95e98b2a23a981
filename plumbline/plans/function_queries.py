"""Queries over the scalar functions and the smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import metrics as fn
from plumbline.operators import coupling, references, rollup, snapshot_diff
from plumbline.plans import analysis_queries as base
from plumbline.session import durable
from plumbline.sources.model import Model

_with, query = base._with, base.query
_M, _D, _PR = _with("m"), _with("d"), _with("pr")


@query(
    "f12_body_measures",
    f"""{_M}, x AS (SELECT method_id, coalesce(loc, 0) > 0 OR method_id % 3 = 0 AS has_body, method_id % 2 = 0 AS is_expression, coalesce(cc, 1) AS cc, greatest(coalesce(loc, 0), 0) AS loc, CASE WHEN hv > 0 AND NOT isnan(hv) THEN hv ELSE 0 END AS hv FROM m)
    SELECT method_id, CASE WHEN NOT has_body OR hv <= 0 OR loc <= 0 THEN 100.0::DOUBLE ELSE round_even(greatest(0, least(100, (171 - 5.2::DOUBLE * ln(hv) - 0.23::DOUBLE * cc - 16.2::DOUBLE * ln(loc)) * 100 / 171)) * 10, 0) / 10 END AS index_now, CASE WHEN has_body THEN cc ELSE 1 END AS complexity, CASE WHEN NOT has_body THEN 0 WHEN loc > 0 THEN loc WHEN is_expression THEN 1 ELSE 0 END AS lines FROM x""",
)
def f12_body_measures(m: Model) -> DataFrame:
    x = m.methods().select(
        "method_id",
        ((F.coalesce("lines_of_executable_code", F.lit(0)) > 0) | (F.col("method_id") % 3 == 0)).alias("has_body"),
        (F.col("method_id") % 2 == 0).alias("is_expression"),
        F.coalesce("cyclomatic_complexity", F.lit(1)).alias("cc"),
        F.greatest(F.coalesce("lines_of_executable_code", F.lit(0)), F.lit(0)).alias("loc"),
        F.when((F.col("halstead_volume") > 0) & ~F.isnan("halstead_volume"), F.col("halstead_volume")).otherwise(0.0).alias("volume"),
    )
    body = fn.body_measures("has_body", "is_expression", "cc", "loc", "volume")
    return x.select("method_id", body["complexity"].alias("complexity"), body["lines"].alias("lines"), fn.round_even(body["maintainability"], 1).alias("index_now"))


@query(
    "f20_escapes",
    f"""{_D} SELECT snapshot_id, pos, replace(message || '|' || id, '|', '\\|') AS markdown, replace(replace(replace(replace(replace(message || chr(10) || '"', '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS script FROM d""",
)
def f20_escapes(m: Model) -> DataFrame:
    rows = m.diagnostics().select("snapshot_id", "pos", F.concat("message", F.lit("|"), "id").alias("a"), F.concat("message", F.lit('\n"')).alias("b"))
    return rows.select("snapshot_id", "pos", fn.markdown_escape("a").alias("markdown"), fn.script_escape("b").alias("script"))


@query(
    "f27_paths",
    f"""{_M} SELECT method_id, split_part(replace(file_path, '\\', '/'), '/', -1) AS base_name, regexp_replace(split_part(replace(file_path, '\\', '/'), '/', -1), '\\.[^.]*$', '') AS stem,
    concat_ws(':', file_path, CAST(start_line + 1 AS VARCHAR)) AS location FROM m""",
)
def f27_paths(m: Model) -> DataFrame:
    return m.methods().select("method_id", fn.basename("file_path").alias("base_name"), fn.stem("file_path").alias("stem"), fn.location("file_path", "start_line").alias("location"))


_DELTAS = f"{_with(*base._DIFF)}, {base._J1}"


@query(
    "f24_meanings",
    f"""{_DELTAS} SELECT head AS head_snapshot_id, project, CASE WHEN total_loc_delta > 0 THEN '+' || total_loc_delta ELSE CAST(total_loc_delta AS VARCHAR) END AS lines_shown,
    CASE WHEN warning_count_delta > 0 THEN 'bad_increase' WHEN warning_count_delta < 0 THEN 'good_decrease' ELSE 'neutral' END AS warnings_meaning,
    CASE WHEN warning_count_delta > 0 THEN '⚠️ **+' || warning_count_delta || '**' WHEN warning_count_delta < 0 THEN '✅ ' || warning_count_delta ELSE '0' END AS warnings_shown,
    CASE WHEN mi_delta <= -10 THEN 'severe_decrease' WHEN mi_delta <= -5 THEN 'moderate_decrease' WHEN mi_delta > 0 THEN 'good_increase' ELSE 'neutral' END AS index_meaning,
    CASE WHEN abs(mi_delta) < 0.0001 THEN '0' ELSE format('{{:+.1f}}', mi_delta) END AS index_shown FROM j""",
)
def f24_meanings(m: Model) -> DataFrame:
    rows = base.j1_project_diff(m).withColumn("meaning", fn.warnings_semantic("warning_count_delta")).withColumn("shown", fn.signed_delta("warning_count_delta"))
    return rows.select(
        "head_snapshot_id", "project", fn.signed_delta("total_loc_delta").alias("lines_shown"), F.col("meaning").alias("warnings_meaning"), fn.decorated("shown", "meaning").alias("warnings_shown"), fn.maintainability_semantic("mi_delta").alias("index_meaning"), fn.signed_delta_decimal("mi_delta").alias("index_shown")
    )


_SIDES = (("errors", "error"), ("warnings", "warning"), ("info", "info"))


@query(
    "f25_solved_added",
    f"""{_with('s', 'pairs', 'pr', 'd', 'm')}, {base._TOTALS_SQL}, {base._D2}
    SELECT head_snapshot_id, {', '.join(f"CASE WHEN coalesce(added_{x}, 0) + coalesce(removed_{x}, 0) + coalesce(changed_{x}, 0) > 0 THEN coalesce({o}_{x}, 0) ELSE greatest({sign}{n}_delta, 0) END AS {k}_{n}" for n, x in _SIDES for k, o, sign in (('solved', 'removed', '-'), ('added', 'added', '')))}
    FROM w LEFT JOIN dc ON head = head_snapshot_id""",
)
def f25_solved_added(m: Model) -> DataFrame:
    rows = base._totals(m).join(base._diagnostic_counts(m), "head_snapshot_id", "left").na.fill(0)
    got = {n: fn.solved_added(f"base_{n}", f"head_{n}", f"removed_{x}", f"added_{x}", f"changed_{x}") for n, x in _SIDES}
    return rows.select("head_snapshot_id", *[got[n][k].alias(f"{k}_{n}") for n, _ in _SIDES for k in ("solved", "added")])


@query(
    "f31_viewer_scores",
    f"""{_PR} SELECT project_row_id, coalesce(error_count, 0) * 5 + coalesce(warning_count, 0) AS score, greatest(1.0::DOUBLE, least(4.0::DOUBLE, coalesce(warning_count, 0) / 2.0::DOUBLE)) AS stroke,
    greatest(9.0::DOUBLE, least(12.0::DOUBLE, coalesce(type_count, 0) / 3.0::DOUBLE)) AS font, greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce(type_count, 0)::DOUBLE)) AS bar,
    CASE WHEN coalesce(type_count, 0) >= 60 THEN 'mi-good' WHEN coalesce(type_count, 0) >= 40 THEN 'mi-medium' ELSE 'mi-poor' END AS quality FROM pr""",
)
def f31_viewer_scores(m: Model) -> DataFrame:
    p = m.projects().na.fill(0, ["warning_count", "type_count"])
    bar = fn.metric_bar(F.col("type_count").cast("double"))
    return p.select("project_row_id", fn.diagnostics_score("error_count", "warning_count").alias("score"), fn.stroke_width("warning_count").alias("stroke"), fn.font_size("type_count").alias("font"), bar["width"].alias("bar"), bar["quality"].alias("quality"))


@query("f32_inverse_index", f"{_M} SELECT method_id, 100 - coalesce(nullif(mi, 0), 100) AS inverse FROM m")
def f32_inverse_index(m: Model) -> DataFrame:
    return m.methods().select("method_id", fn.inverse_maintainability("maintainability_index").alias("inverse"))


@query("f26_severity_codes", f"{_D} SELECT snapshot_id, pos, CASE severity WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS code, lower(id) AS id_key FROM d")
def f26_severity_codes(m: Model) -> DataFrame:
    rows = m.diagnostics().withColumn("label", F.initcap(fn.severity_label("severity")))
    return rows.select("snapshot_id", "pos", fn.severity_rank("label").alias("code"), F.lower("id").alias("id_key"))


@query("f22_edge_kinds", f"{_with('e')} SELECT CASE dep_type WHEN 0 THEN 'project' WHEN 1 THEN 'assembly' WHEN 2 THEN 'namespace' WHEN 3 THEN 'type' WHEN 4 THEN 'method' END AS kind, count(*) AS n, count(*) FILTER ({base._BCL.replace('x ', 'to_entity ')}) AS framework FROM e GROUP BY 1")
def f22_edge_kinds(m: Model) -> DataFrame:
    return m.edges().groupBy(fn.dependency_kind("dep_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(fn.is_bcl("to_entity")).alias("framework"))


@query(
    "a17_single_project_coupling",
    f"""{_with('e', 'a')}, {base._coupling_sql(2)}, {base._coupling_sql(3)}, c AS ({base._measure_sql('r2')}), c3 AS ({base._measure_sql('r3')}) SELECT 'namespace' AS layer, * FROM c UNION ALL SELECT 'type', * FROM c3
    UNION ALL SELECT 'project', snapshot_id, 'single', 0, 0, 0.0, 0, 0, 0, 0 FROM (SELECT DISTINCT snapshot_id FROM a)""",
)
def a17_single_project_coupling(m: Model) -> DataFrame:
    return coupling.single_project_coupling(m.edges(), "single")


@query("a38_reference_totals", f"{_with('s', 'pairs', 'e', 'pr')}, {base._ADDED} SELECT head AS head_snapshot_id, count(DISTINCT lower(project)) AS projects, count(*) AS total_added, count(DISTINCT lower(ref)) AS unique_added, count(*) FILTER ({base._BCL.replace('x ', 'ref ')}) AS framework_added FROM added GROUP BY 1")
def a38_reference_totals(m: Model) -> DataFrame:
    return references.added_totals(base._added(m))


@query(
    "t6_most_added_references",
    f"""{_with('s', 'pairs', 'e', 'pr')}, {base._ADDED}, n AS (SELECT head, project, count(*) AS added FROM added GROUP BY 1, 2)
    SELECT head AS head_snapshot_id, project, added, CAST(rn AS INTEGER) AS rank_no, greatest(k - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY added DESC, project) AS rn, count(*) OVER (PARTITION BY head) AS k FROM n) WHERE rn <= 10""",
)
def t6_most_added_references(m: Model) -> DataFrame:
    added = base._added(m).groupBy("head_snapshot_id", "project").agg(F.count(F.lit(1)).alias("added"))
    w = Window.partitionBy("head_snapshot_id")
    ranked = added.withColumn("rank_no", F.row_number().over(w.orderBy(F.desc("added"), "project"))).withColumn("more", F.greatest(F.count(F.lit(1)).over(w) - 10, F.lit(0)))
    return ranked.where("rank_no <= 10")


@query(
    "j13_exact_matches",
    f"""{_with('s', 'pairs', 'd')}, x AS (SELECT head, lower(project) AS a, lower(id) AS b, severity, lower(message) AS c, lower(file) AS f, line, col_no, count(*) FILTER (snapshot_id = base) AS nb, count(*) FILTER (snapshot_id = head) AS nh
        FROM pairs JOIN d ON snapshot_id IN (base, head) GROUP BY ALL)
    SELECT head AS head_snapshot_id, CAST(sum(least(nb, nh)) AS BIGINT) AS exact, CAST(sum(nb) AS BIGINT) AS base_rows, CAST(sum(nh) AS BIGINT) AS head_rows FROM x GROUP BY 1""",
)
def j13_exact_matches(m: Model) -> DataFrame:
    cells = durable(snapshot_diff.diagnostic_cells(m.diagnostics(), base.snapshot_roles(base._pairs(m))))
    left = snapshot_diff.surplus_rows(cells, ["pair", "ka", "kb", "line", "col"])
    every = cells.select("pair", "sign", F.lit(0).alias("left")).unionByName(left.select("pair", "sign", F.lit(1).alias("left")))
    count = lambda sign, of: F.count_if((F.col("sign") == sign) & (F.col("left") == of))
    return every.groupBy(F.col("pair").alias("head_snapshot_id")).agg((count(-1, 0) - count(-1, 1)).alias("exact"), count(-1, 0).alias("base_rows"), count(1, 0).alias("head_rows"))


@query("x22_external_only", f"{_with('e', 'a')}, {base._coupling_sql(2)}, c AS ({base._measure_sql('r2')}) SELECT snapshot_id, entity, ed FROM c WHERE ed > 0")
def external_only(m: Model) -> DataFrame:
    return coupling.entity_coupling(m.edges(), coupling.NAMESPACE).where("ed > 0").select("snapshot_id", "entity", "ed")


@query(
    "t14_mixed_order",
    f"""{_D}, x AS (SELECT snapshot_id, pos, CASE WHEN pos % 2 = 0 THEN CAST(line AS VARCHAR) ELSE id END AS shown FROM d) SELECT snapshot_id, pos, shown FROM x WHERE shown IS NOT NULL ORDER BY try_cast(shown AS DOUBLE) NULLS LAST, shown, snapshot_id, pos LIMIT 5000""",
)
def t14_mixed_order(m: Model) -> DataFrame:
    rows = m.diagnostics().select("snapshot_id", "pos", F.when(F.col("pos") % 2 == 0, F.col("line").cast("string")).otherwise(F.col("id")).alias("shown")).where("shown is not null")
    return rows.orderBy(*rollup.mixed_order("shown"), "snapshot_id", "pos").limit(5000)


@query("m5_snapshot_rows", f"{_with('s')} SELECT solution_path, count(*) AS snapshots, min(snapshot_id) AS first_id, count(*) FILTER (lower(analysis_mode) = 'full') AS full_mode FROM s GROUP BY 1")
def m5_snapshot_rows(m: Model) -> DataFrame:
    return m.snapshots().groupBy("solution_path").agg(F.count(F.lit(1)).alias("snapshots"), F.min("snapshot_id").alias("first_id"), F.count_if(F.lower("analysis_mode") == "full").alias("full_mode"))


def load() -> None:
    """The queries of this module register themselves with those of the analytics when it is imported."""
