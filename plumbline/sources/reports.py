"""Report sinks: JSON documents made in the engine, and texts rendered from small results."""

from __future__ import annotations

import html
import json
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import metrics as fn
from plumbline.operators.references import package_counts
from plumbline.operators.rollup import type_rollup

#: Extension by format (fixed values).
EXTENSIONS = {"html": "html", "compact": "slr", "json": "json"}


#: A graph layer without nodes.
NO_LAYER = '{"n":[],"e":[]}'


def _sorted_list(*columns: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def _positional(*columns: Column) -> Column:
    """A JSON array of values of several types, as text; a missing value is ``null``."""
    cells = [F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *[F.substring(c, F.lit(6), F.length(c) - 6) for c in cells]), F.lit("]"))


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(items, ","), F.lit("")), F.lit("]"))


def project_measures(projects: DataFrame, coupling: DataFrame, maintainability: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """The named ``projects`` with ``mi, id, idx, dr, ed, edb, edp``, 0 where there is nothing to measure.

    ``ed`` is that of the coupling of projects, which has no external edges; ``edb`` and ``edp`` count the package
    ``references`` of the framework and others, and without these are those of the coupling.
    """
    keys = ["snapshot_id", "_n"]
    ties = coupling.select("snapshot_id", F.col("entity").alias("_n"), "id", "idx", fn.round_even("dr", 2).alias("dr"), "ed", "edb", "edp")
    if references is not None:
        ties = ties.drop("edb", "edp").join(package_counts(references).withColumnRenamed("n", "_n").drop("ed"), keys, "full_outer")
    mi = maintainability.where("project is not null").select("snapshot_id", F.col("project").alias("_n"), fn.round_even("avg_mi", 1).alias("mi"))
    joined = projects.where("project_name is not null").withColumn("_n", F.col("project_name")).join(mi, keys, "left").join(ties, keys, "left")
    return joined.na.fill(0, ["id", "idx", "ed", "edb", "edp"]).na.fill(0.0, ["mi", "dr"]).drop("_n")


def compact_projects(projects: DataFrame, coupling: DataFrame, maintainability: DataFrame, diagnostics: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Project rows under the short names of the compact format, one per project and snapshot.

    What is missing of a project's coupling, methods or diagnostics reads as zero. ``ed``, ``edb`` and ``edp`` count
    the package ``references``; without these they are those of the coupling, which has no external edges.
    """
    wide = project_measures(projects, coupling, maintainability, references)
    own = wide.select(
        "snapshot_id",
        F.col("project_name").alias("n"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(a) for c, a in (("type_count", "tc"), ("method_count", "mc"), ("total_cc", "cc"), ("total_loc", "loc"), ("max_dit", "dit"))],
        *["mi", "id", "idx", "dr", (F.col("ed") if references is None else F.col("edb") + F.col("edp")).alias("ed"), "edb", "edp"],
    )
    found = diagnostics.select("snapshot_id", F.col("project").alias("n"), F.nullif("errors", F.lit(0)).alias("err"), F.nullif("warnings", F.lit(0)).alias("warn"))
    return own.join(found, ["snapshot_id", "n"], "left")


def diagnostic_documents(diagnostics: DataFrame) -> DataFrame:
    """``snapshot_id, diag``: three counts and one positional array per diagnostic, in order of position.

    Every diagnostic is listed, also one without a project; a missing or unknown severity is 0.
    """
    code = F.when(F.col("severity").between(1, 3), F.col("severity")).otherwise(0)
    item = _positional(F.col("project"), F.col("id"), code, F.col("message"), F.col("file"), F.col("line"), F.col("col_no"))
    counts = [F.count_if(F.col("severity") == k).alias(n) for k, n in ((3, "e"), (2, "w"), (1, "i"))]
    per = diagnostics.groupBy("snapshot_id").agg(*counts, F.transform(_sorted_list(F.col("pos"), item.alias("r")), lambda s: s["r"]).alias("d"))
    head = F.concat(*[part for n in ("e", "w", "i") for part in (F.lit(f'"{n}":'), F.col(n).cast("string"), F.lit(","))])
    return per.select("snapshot_id", F.concat(F.lit("{"), head, F.lit('"d":'), _listed(F.col("d")), F.lit("}")).alias("diag"))


def compact_reports(snapshots: DataFrame, projects: DataFrame, graphs: DataFrame | None = None, diagnostics: DataFrame | None = None) -> DataFrame:
    """``snapshot_id, report``: one compact JSON document per snapshot, projects in name order.

    A document holds the projects of one snapshot, which bounds it; nulls and defaults are left out. With
    ``graphs`` (``snapshot_id, graph``) each has ``g``, with empty layers where there is none; with
    ``diagnostics`` each snapshot that has any has ``diag``.
    """
    columns = [c for c in projects.columns if c != "snapshot_id"]
    listed = projects.groupBy("snapshot_id").agg(_sorted_list(*[F.col(c) for c in columns]).alias("prj"))
    joined = snapshots.join(listed, "snapshot_id", "left")
    body = F.struct(
        F.lit(1).alias("v"),
        F.col("solution_path").alias("p"),
        F.unix_millis(F.col("analyzed_at").cast("timestamp")).alias("t"),
        F.coalesce("prj", F.array().cast(listed.schema["prj"].dataType)).alias("prj"),
        F.col("commit_sha").alias("gitSha"),
        F.col("branch_name").alias("gitBranch"),
        F.col("remote_url").alias("gitRemote"),
        F.when(F.col("is_dirty"), F.lit(True)).alias("gitDirty"),
        F.col("tool_version").alias("toolVer"),
        (F.lower("analysis_mode") == "full").alias("hasCm"),
    )
    text = F.to_json(body, {"ignoreNullFields": "true"})
    parts = []
    if graphs is not None:
        joined = joined.join(graphs, "snapshot_id", "left")
        parts.append(F.concat(F.lit(',"g":'), F.coalesce("graph", F.lit(f'{{"p":{NO_LAYER},"ns":{NO_LAYER}}}'))))
    if diagnostics is not None:
        joined = joined.join(diagnostic_documents(diagnostics), "snapshot_id", "left")
        parts.append(F.coalesce(F.concat(F.lit(',"diag":'), F.col("diag")), F.lit("")))
    return joined.select("snapshot_id", F.concat(F.substring(text, F.lit(1), F.length(text) - 1), *parts, F.lit("}")).alias("report"))


def hierarchical_reports(types: DataFrame, methods: DataFrame) -> DataFrame:
    """``snapshot_id, project, body``: namespaces, types and methods of a project nested under short names, with their sums.

    Nesting is done level by level, each in name order; a project is one document, as the format asks, which bounds it.
    """
    digit = lambda c: fn.round_even(c, 1)
    mean = lambda total, n: digit(F.coalesce(F.col(total).cast("double") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)))
    own = methods.where("type_id is not null").groupBy("type_id").agg(
        _sorted_list(fn.short_name("full_name").alias("n"), F.col("cyclomatic_complexity").alias("cc"), F.col("lines_of_executable_code").alias("loc"), digit("halstead_volume").alias("hv"), digit("maintainability_index").alias("mi"), F.col("start_line").alias("sl"), F.col("end_line").alias("el")).alias("m")
    )
    per_type = type_rollup(types, methods).join(own, "type_id", "left").withColumn("k", F.col("n_methods"))
    item = [fn.short_name("full_name").alias("n"), F.col("depth_of_inheritance").alias("dit"), F.col("cc"), F.col("loc"), mean("mi_sum", "mi_n").alias("mi"), F.col("m")]
    sums = [F.count(F.lit(1)).alias("tc"), F.sum("k").alias("mc"), F.sum("cc").alias("cc"), F.sum("loc").alias("loc"), F.coalesce(F.max("depth_of_inheritance"), F.lit(0)).alias("dit"), F.sum("mi_sum").alias("mi_sum"), F.sum("mi_n").alias("mi_n")]
    spaces = per_type.groupBy("snapshot_id", "project", "namespace").agg(*sums, _sorted_list(*item).alias("types"))
    whole = _sorted_list(F.col("namespace").alias("n"), F.col("tc"), F.col("mc"), F.col("cc"), F.col("loc"), F.col("dit"), mean("mi_sum", "mi_n").alias("mi"), F.col("types"))
    return spaces.groupBy("snapshot_id", "project").agg(whole.alias("ns")).select("snapshot_id", "project", F.to_json(F.struct("ns")).alias("body"))


def full_reports(snapshots: DataFrame, projects: DataFrame, types: DataFrame, methods: DataFrame, diagnostics: DataFrame, packages: DataFrame, references: DataFrame) -> DataFrame:
    """``snapshot_id, report``: the full JSON document of each snapshot, nulls left out, as ``read_reports`` reads it.

    ``packages`` and ``references`` have ``snapshot_id, project, ref``. A project that only types or diagnostics name is
    listed too. A snapshot is one document, as the format asks, which bounds it.
    """
    rows = methods.where("type_id is not null").groupBy("type_id").agg(
        _sorted_list(F.col("full_name").alias("fullName"), F.col("method_id"), F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("cyclomatic_complexity").alias("cyclomaticComplexity"), F.col("lines_of_executable_code").alias("linesOfExecutableCode"), F.when(~F.isnan("halstead_volume"), F.col("halstead_volume")).alias("halsteadVolume"), F.col("maintainability_index").alias("maintainabilityIndex")).alias("methods")
    )
    key = ["snapshot_id", "name"]
    named = lambda df: df.withColumnRenamed("project", "name")
    per_type = named(types.join(rows, "type_id", "left").groupBy("snapshot_id", "project").agg(_sorted_list(F.col("full_name").alias("fullName"), F.col("type_id"), F.col("file_path").alias("filePath"), F.col("depth_of_inheritance").alias("depthOfInheritance"), "methods").alias("types")))
    counts = [F.count_if(F.col("severity") == k).alias(n) for k, n in ((3, "errorCount"), (2, "warningCount"), (1, "infoCount"), (0, "hiddenCount"))]
    items = _sorted_list(F.col("pos"), F.col("id"), F.col("message"), F.initcap(fn.severity_label("severity")).alias("severity"), F.col("file"), F.col("line"), F.col("col_no").alias("column"), F.col("category"), F.col("help_link").alias("helpLink"))
    found = named(diagnostics.groupBy("snapshot_id", "project").agg(*counts, items.alias("diagnostics"))).select(*key, F.struct("errorCount", "warningCount", "infoCount", "hiddenCount", "diagnostics").alias("diagnostics"))
    lists = [named(df.groupBy("snapshot_id", "project").agg(F.array_sort(F.collect_set("ref")).alias(n))) for df, n in ((packages, "packageReferences"), (references, "projectReferences"))]
    own = projects.select("snapshot_id", F.col("project_name").alias("name"), F.col("file_path").alias("filePath")).groupBy(*key).agg(F.min("filePath").alias("filePath"))
    for part in (per_type, found):
        other = part.toDF("_s", "_n", part.columns[2])
        both = own.join(other, F.col("snapshot_id").eqNullSafe(F.col("_s")) & F.col("name").eqNullSafe(F.col("_n")), "full_outer")
        own = both.withColumn("snapshot_id", F.coalesce("snapshot_id", "_s")).withColumn("name", F.coalesce("name", "_n")).drop("_s", "_n")
    for part in lists:
        own = own.join(part, key, "left")
    listed = own.groupBy("snapshot_id").agg(_sorted_list("name", "filePath", "types", "packageReferences", "projectReferences", "diagnostics").alias("projects"))
    body = F.struct(
        F.col("solution_path").alias("solutionPath"), F.date_format(F.col("analyzed_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("analyzedAt"), F.col("tool_version").alias("toolVersion"),
        F.when(F.lower("analysis_mode") == "full", 0).otherwise(1).alias("analysisMode"), F.coalesce("projects", F.array().cast(listed.schema["projects"].dataType)).alias("projects"),
        F.struct(F.col("commit_sha").alias("commitSha"), F.col("branch_name").alias("branchName"), F.col("remote_url").alias("remoteUrl"), F.col("is_dirty").alias("isDirty")).alias("gitInfo"),
    )
    return snapshots.join(listed, "snapshot_id", "left").select("snapshot_id", F.to_json(body, {"ignoreNullFields": "true"}).alias("report"))


def graph_document(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """``snapshot_id, layer``: nodes and edges as positional arrays in one JSON object."""
    row = lambda cs: _positional(*[F.col(c) for c in cs])
    n = nodes.groupBy("snapshot_id").agg(F.transform(_sorted_list(F.col(columns[0]).alias("k"), row(columns).alias("r")), lambda s: s["r"]).alias("n"))
    e = edges.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(row(["source", "target", "weight"]))).alias("e"))
    both = n.join(e, "snapshot_id", "left")
    return both.select("snapshot_id", F.concat(F.lit('{"n":'), _listed(F.col("n")), F.lit(',"e":'), _listed(F.col("e")), F.lit("}")).alias("layer"))


def graphs_of_layers(projects: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``snapshot_id, graph``: both layers in one JSON object; a layer that a snapshot lacks is empty."""
    both = projects.withColumnRenamed("layer", "p").join(namespaces.withColumnRenamed("layer", "ns"), "snapshot_id", "full")
    part = lambda c: F.coalesce(F.col(c), F.lit(NO_LAYER))
    return both.select("snapshot_id", F.concat(F.lit('{"p":'), part("p"), F.lit(',"ns":'), part("ns"), F.lit("}")).alias("graph"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls left out, in parallel."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


# ---- texts from small results


def default_filename(commit_sha: str | None, branch: str | None, form: str, now: datetime | None = None) -> str:
    extension = EXTENSIONS.get(form, "json")
    if commit_sha:
        return f"{commit_sha[:7]}-{sanitise(branch or '')}.{extension}"
    return f"report-{(now or datetime.now()).strftime('%Y-%m-%d-%H%M%S')}.{extension}"


def sanitise(branch: str) -> str:
    return re.sub(r'[<>:"|?*/\\\x00-\x1f]', "_", branch)


def write_or_print(text: str, path: str | None) -> None:
    if path:
        Path(path).write_text(text, encoding="utf-8")
    else:
        print(text)


def _escape(text: object) -> str:
    return str(text).replace("|", "\\|")


def _signed(value: float, digits: int = 0) -> str:
    if abs(value) < 0.0001:
        return "0"
    return f"{value:+.{digits}f}"


def _marked(text: str, meaning: str) -> str:
    return text if text == "0" else fn.MARKS.get(meaning, "%s") % text


def markdown_table(head: list[str], rows: list[list[object]], right: int = 1) -> list[str]:
    """Lines of a table; columns from number ``right`` on are aligned to the right."""
    rule = ["---" if i < right else "---:" for i in range(len(head))]
    return [f"| {' | '.join(map(str, r))} |" for r in (head, rule, *rows)]


def _complexity_meaning(delta: int, base: int) -> str:
    return "bad_increase" if delta > 50 or base > 0 and delta / base > 0.1 else "neutral"


def _index_meaning(delta: float) -> str:
    return "severe_decrease" if delta <= -10 else "moderate_decrease" if delta <= -5 else "good_increase" if delta > 0 else "neutral"


def _warning_meaning(delta: int) -> str:
    return "bad_increase" if delta > 0 else "good_decrease" if delta < 0 else "neutral"


def name_list(names: list[str], fresh: frozenset[str] = frozenset(), most: int = 3) -> str:
    """The first names, marked where they are new to the solution (``fresh``, in lower case), and how many more there are."""
    shown = [f"`{_escape(n)}`{' 🆕' if n.lower() in fresh else ''}" for n in names[:most]]
    return ", ".join(shown + [f"+{len(names) - most} more"] * (len(names) > most)) or "none"


def _diagnostic_section(totals: dict, diagnostics: dict, items: dict[str, list[dict]], least_level: str) -> list[str]:
    rows = []
    for label, name, meaning in (("Errors", "errors", "critical_increase"), ("Warnings", "warnings", "bad_increase"), ("Info", "info", "neutral")):
        b, h = totals[f"base_{name}"], totals[f"head_{name}"]
        solved, added, moved = (diagnostics.get(f"{k}_{name}", 0) for k in ("removed", "added", "changed"))
        if not (solved or added or moved):
            solved, added = max(0, b - h), max(0, h - b)
        rows.append([label, b, h, solved, _marked(str(added), meaning)])
    out = ["### Diagnostics", "", *markdown_table(["Metric", "Base", "Head", "Solved", "Added"], rows), ""]
    least = level_of(least_level)
    for heading, name in (("#### Added Diagnostics", "added"), ("#### Resolved Diagnostics", "removed")):
        ranked = [(i["severity"] if isinstance(i["severity"], int) else level_of(i["severity"], 0), i) for i in items.get(name, [])]
        shown = [[fn.SEVERITIES[s], _escape(i["id"]), _escape(i["message"]), f"{i['line']}:{i['col_no']}", _escape(i["file"])] for s, i in ranked if s >= least]
        out += [heading, "", *(markdown_table(["Severity", "Code", "Description", "Location", "File"], shown, right=5) if shown else ["None"]), ""]
    return out


def _reference_section(references: list[dict], fresh: frozenset[str], most: int) -> list[str]:
    kept = sorted((r for r in references if r["added"]), key=lambda r: -len(r["added"]))
    if not kept:
        return []
    total, unique = sum(len(r["added"]) for r in kept), len({n.lower() for r in kept for n in r["added"]})
    out = ["### Project References Changes", "", f"Added direct project refs in {len(kept)} project(s), {total} total change(s), {unique} unique.", ""]
    out += [f"- `{_escape(r['project'])}` → {name_list(r['added'], fresh)}" for r in kept[:most]]
    return out + _and_more(kept, most)


def _external_section(externals: list[dict], fresh: frozenset[str], most: int) -> list[str]:
    kept = sorted((r for r in externals if r["bcl"] or r["packages"]), key=lambda r: -abs(r.get("delta", 0)))
    if not kept:
        return []
    counts = [sum(len(r[k]) for r in kept) for k in ("bcl", "packages")]
    out = ["### NuGet Dependencies Changes", "", f"Added direct dependencies in {len(kept)} project(s): {counts[0]} BCL, {counts[1]} package.", ""]
    for r in kept[:most]:
        parts = [f"{label}: {name_list(r[k], fresh)}" for label, k in (("BCL", "bcl"), ("Packages", "packages")) if r[k]]
        out.append(f"- `{_escape(r['project'])}` → {'; '.join(parts)}")
    return out + _and_more(kept, most)


def _and_more(rows: list, most: int) -> list[str]:
    return [f"- ...and {len(rows) - most} more project(s)"] * (len(rows) > most) + [""]


def _maintainability_section(projects: list[dict]) -> list[str]:
    kept = [p for p in projects if not p["is_added"] and not p["is_removed"] and any(p[f"{m}_delta"] for m in ("mi", "total_cc", "total_loc", "warning_count"))]
    if not kept:
        return []
    rows = [
        [
            _escape(p["project"]), f"{p['base_mi']:.1f}", f"{p['head_mi']:.1f}", _marked(_signed(p["mi_delta"], 1), _index_meaning(p["mi_delta"])),
            _signed(p["total_cc_delta"]), _signed(p["total_loc_delta"]), _marked(_signed(p["warning_count_delta"]), _warning_meaning(p["warning_count_delta"])),
        ]
        for p in sorted(kept, key=lambda p: -abs(p["mi_delta"]))
    ]
    return ["### Maintainability Changes", "", *markdown_table(["Project", "MI (Base)", "MI (Head)", "Delta", "Complexity Δ", "LOC Δ", "Warnings Δ"], rows), ""]


def _overall_section(totals: dict, full: bool) -> list[str]:
    rows = [["Projects", totals["base_projects"], totals["head_projects"], _signed(totals["projects_delta"])]]
    if full:
        for label, name in (("Types", "types"), ("Methods", "methods"), ("Cyclomatic Complexity", "cc"), ("Lines of Code", "loc")):
            meaning = _complexity_meaning(totals["cc_delta"], totals["base_cc"]) if name == "cc" else "neutral"
            rows.append([label, totals[f"base_{name}"], totals[f"head_{name}"], _marked(_signed(totals[f"{name}_delta"]), meaning)])
        delta = totals["avg_mi_delta"]
        rows.append(["Avg Maintainability", f"{totals['base_avg_mi']:.1f}", f"{totals['head_avg_mi']:.1f}", _marked(_signed(delta, 1), _index_meaning(delta))])
    return ["### Overall Metrics", "", *markdown_table(["Metric", "Base", "Head", "Delta"], rows), ""]


def has_complexity(base: dict, head: dict) -> bool:
    """Whether both snapshots have measures of their methods."""
    return all(str(s.get("analysis_mode") or "").lower() == "full" for s in (base, head))


def render_markdown(base: dict, head: dict, totals: dict, diagnostics: dict, items: dict[str, list[dict]], projects: list[dict], references: list[dict] = (), externals: list[dict] = (), fresh: list[str] = (), max_projects: int = 10, least_level: str = "info", title: str = "Diff Summary") -> str:
    """The Markdown report of one comparison; sections in fixed order, lists of projects cut at ``max_projects``.

    ``references`` has ``project, added``, ``externals`` ``project, bcl, packages, delta``, both of projects in both
    snapshots; ``fresh`` names what is new to the solution. Sorts keep the given order among equals.
    """
    sha = lambda s: (s.get("commit_sha") or "").strip()[:7] or "unknown"
    new, full = frozenset(n.lower() for n in fresh), has_complexity(base, head)
    out = [f"## {title}", "", f"Base: `{sha(base)}` {base.get('branch_name') or ''}", f"Head: `{sha(head)}` {head.get('branch_name') or ''}", f"Analysis mode: `{head.get('analysis_mode')}`", ""]
    out += _diagnostic_section(totals, diagnostics, items, least_level) + _reference_section(references, new, max_projects) + _external_section(externals, new, max_projects)
    return "\n".join(out + (_maintainability_section(projects) if full else []) + _overall_section(totals, full))


def level_of(name: str | None, default: int = 1) -> int:
    """The rank of a severity by its name in any case; ``default``, info, where it names none."""
    said = (name or "").strip().lower()
    return fn.SEVERITIES.index(said) if said in fn.SEVERITIES else default


#: Modes of an analysis by their names in lower case (fixed values).
MODES = {"full": 0, "diagnosticsandreferences": 1}


def mode_of(name: str) -> int:
    """The number of a mode by its name in any case; ValueError where it names none."""
    if (name or "").strip().lower() not in MODES:
        raise ValueError(f"no mode of an analysis: {name}")
    return MODES[name.strip().lower()]


def render_diff(form: str, comparison: dict, **options) -> str:
    """One comparison as ``json``, ``html``, ``markdown`` or ``summary``; ValueError for any other form.

    ``comparison`` holds the arguments of ``render_markdown`` by name.
    """
    if form == "json":
        return json.dumps({k: v for k, v in comparison.items() if v is not None}, indent=2, default=str, ensure_ascii=False)
    if form == "markdown":
        return render_markdown(**comparison, **options)
    if form == "html":
        mode = "full" if has_complexity(comparison["base"], comparison["head"]) else "lightweight"
        return render_html("Diff", datetime.now(timezone.utc), json.dumps(comparison, default=str), render_markdown(**comparison, **options), mode)
    if form == "summary":
        t = comparison["totals"]
        return "\n".join(f"{label}: {t[f'base_{n}']} -> {t[f'head_{n}']} ({_signed(t[f'{n}_delta'])})" for label, n in (("Projects", "projects"), ("Errors", "errors"), ("Warnings", "warnings"), ("Cyclomatic Complexity", "cc"), ("Lines of Code", "loc")))
    raise ValueError(f"no such form of a comparison: {form}")


def warning_lines(warnings: list[str], most: int = 10) -> list[str]:
    """The first warnings, then how many more there are."""
    return warnings[:most] + [f"... and {len(warnings) - most} more"] * (len(warnings) > most)


def render_summary(snapshot: dict, totals: dict, coupling: dict | None, top: list[dict], low: list[dict]) -> str:
    """The text summary of one snapshot."""
    out = ["=== Analysis Summary ===", f"Tool Version: v{snapshot.get('tool_version')}", f"Analysis Mode: {snapshot.get('analysis_mode')}", f"Solution: {snapshot.get('solution_path')}", f"Analyzed at: {snapshot.get('analyzed_at')}", ""]
    out += [f"{label}: {totals.get(name, 0)}" for label, name in (("Projects", "projects"), ("Types", "types"), ("Methods", "methods"), ("Total Cyclomatic Complexity", "cc"), ("Total Lines of Executable Code", "loc"))]
    if coupling:
        out += ["", "=== Coupling Summary ===", f"Total Dependencies: {coupling['total_dependencies']}"]
        out += [f"{label}: {coupling[name]:.{d}f}" for label, name, d in (("Average Internal Dependencies", "avg_id", 1), ("Average Internal Dependents", "avg_idx", 1), ("Average Dependency Ratio", "avg_dr", 2), ("Average External Dependencies", "avg_ed", 1))]
        out += [f"{label}: {coupling[name]}" for label, name in (("Most Coupled Entity", "most_coupled"), ("Most Referenced Component", "most_dependent"), ("Highest-Level Consumer", "highest_consumer")) if coupling.get(name)]
    for heading, rows in (("High complexity methods", top), ("Low maintainability methods", low)):
        if rows:
            out += ["", f"{heading}:", *[f"  {r['full_name']}: {r['measure']}" for r in rows]]
    return "\n".join(out)


#: Tabs of a page in their order; those of methods and coupling need a full analysis.
TABS = {"summary": "Summary", "projects": "Projects", "complexity": "Complexity", "coupling": "Coupling", "graph": "Graph", "diagnostics": "Diagnostics"}
FULL_ONLY = frozenset(["complexity", "coupling", "graph"])
PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title></head>
<body><h1>@TITLE@</h1><p>@WHEN@</p>
<nav>@TABS@</nav>
@SECTIONS@
<script>const REPORT = JSON.parse("@DATA@");
for (const tab of document.querySelectorAll("nav a")) tab.onclick = () => { for (const s of document.querySelectorAll("section")) s.hidden = "#" + s.id !== tab.hash; };
</script></body></html>
"""


def script_literal(text: str) -> str:
    """Text inside a script's string literal; a closing tag cannot end the script early."""
    out = json.dumps(text, ensure_ascii=False)[1:-1]
    return out.replace("</", "<\\/")


def render_html(title: str, when: datetime, document: str, summary: str, mode: str = "full") -> str:
    """One self-contained page with the JSON document embedded; no reference to other hosts.

    Tokens of the page are replaced in one pass, so that no content is taken for a token. Without a full analysis the
    tabs that need one are left out.
    """
    tabs = {k: v for k, v in TABS.items() if mode.lower() == "full" or k not in FULL_ONLY}
    sections = [f'<section id="{k}"{"" if k == "summary" else " hidden"}><h2>{v}</h2>{f"<pre>{html.escape(summary)}</pre>" if k == "summary" else ""}</section>' for k, v in tabs.items()]
    values = {
        "TITLE": html.escape(title),
        "WHEN": when.strftime("%Y-%m-%d %H:%M:%S UTC"),
        "TABS": " ".join(f'<a href="#{k}">{v}</a>' for k, v in tabs.items()),
        "SECTIONS": "\n".join(sections),
        "DATA": script_literal(document),
    }
    return re.sub("@([A-Z]+)@", lambda found: values.get(found[1], found[0]), PAGE)
