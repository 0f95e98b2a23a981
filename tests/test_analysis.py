"""Analytics operators on the survey's fixtures and on random tables."""

import json
import random
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from plumbline.functions.calculator import Calculator
from plumbline.operators import coupling, diff, references, rollup
from plumbline.operators.tokens import depth_of_inheritance, halstead, token_counts
from plumbline.plans import analysis_queries as A
from plumbline.plans.comparison import comparison_of
from plumbline.session import checkpoint_root, durable, release
from plumbline.sources import files, frontend, reports, versions
from plumbline.sources.model import Model
from plumbline.streaming.edges import drain, edge_stream, running_edges
from tests.conftest import MIDDLE

EDGE = "snapshot_id string, from_entity string, to_entity string, dep_type int, reference_count long"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("App", "Library", 0, 1), ("App", "Library", 0, 3), ("App.Core", "Library.Core", 2, 1), ("App.Core", "Library.Core", 2, 2), ("Library.Core", "System", 2, 1), ("App.Core.Controller", "Library.Core.Service", 3, 5)]
    return spark.createDataFrame([("s", *r) for r in rows], EDGE)


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_edges_and_coupling_of_the_fixture(spark, edges):
    assert {(r["from_entity"], r["reference_count"]) for r in coupling.aggregate_edges(edges).collect()} == {("App", 4), ("App.Core", 3), ("Library.Core", 1), ("App.Core.Controller", 5)}
    projects = spark.createDataFrame([("s", "App"), ("s", "Library"), ("s", "Idle")], "snapshot_id string, project_name string")
    got = by(coupling.project_coupling(edges, projects), "entity")
    assert (got["App"]["id"], got["App"]["idx"], got["App"]["dr"]) == (1, 0, 1.0) and (got["Library"]["id"], got["Library"]["idx"], got["Library"]["dr"]) == (0, 1, 0.0)
    assert got["Idle"]["strength"] == 0 and got["Idle"]["dr"] == 0.0
    spaces = by(coupling.entity_coupling(edges, 2), "entity")
    assert (spaces["App.Core"]["id"], spaces["App.Core"]["ed"]) == (1, 0) and (spaces["Library.Core"]["idx"], spaces["Library.Core"]["edb"]) == (1, 1)
    stats = coupling.collector_stats(edges).collect()[0]
    assert (stats["total_edges_added"], stats["unique_edges"]) == (6, 4)


def test_framework_split_of_the_fixture(spark):
    targets = ["System", "System.Collections.Generic", "System.Collections.Generic", "Microsoft.Extensions.Logging", "Newtonsoft.Json", "Company.Systematic"]
    df = spark.createDataFrame([("s", "A", t, 2, 1) for t in targets], EDGE)
    got = by(coupling.entity_coupling(df, 2), "entity")["A"]
    assert (got["edb"], got["edp"], got["ed"]) == (3, 2, 5)


def test_invariants_on_random_edges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("st"), rng.choice("abcdef"), rng.choice(["a", "b", "System", "X.Y", "z"]), rng.choice([2, 2, 3]), rng.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, EDGE)
    for r in coupling.entity_coupling(df, 2).collect():
        targets = {t for s, f, t, k, _ in rows if (s, f, k) == (r["snapshot_id"], r["entity"], 2)}
        assert r["id"] + r["edb"] + r["edp"] == len(targets)
    once = coupling.aggregate_edges(df)
    assert sorted(once.collect()) == sorted(coupling.aggregate_edges(once.repartition(7)).collect())
    assert coupling.aggregate_edges(df.limit(0)).count() == 0


def test_namespace_graph_of_the_fixture(spark):
    types = spark.createDataFrame([(1, "s", "P", "NS1.Class1", 2), (2, "s", "P", "NS1.Class2", 1), (3, "s", "P", "NS2.Class3", 0), (4, "s", "P", "Bare", None)], "type_id long, snapshot_id string, project string, full_name string, depth_of_inheritance int")
    methods = spark.createDataFrame([(1, 3, 10, 80.0), (2, 5, 15, 60.0), (3, 2, 8, 90.0), (None, 9, 9, 9.0)], "type_id long, cyclomatic_complexity int, lines_of_executable_code int, maintainability_index double")
    per = rollup.type_rollup(types, methods)
    got = by(rollup.namespace_rollup(per, across_projects=True), "namespace")
    assert {k: got["NS1"][k] for k in ("total_loc", "total_cc", "avg_mi", "type_count", "method_count", "max_dit")} == {"total_loc": 25, "total_cc": 8, "avg_mi": 70.0, "type_count": 2, "method_count": 2, "max_dit": 2}
    assert (got["(global)"]["avg_mi"], got["(global)"]["type_count"], got["(global)"]["method_count"]) == (0.0, 1, 0)
    levels = {r["level"]: r for r in rollup.hierarchy(per).where("level in ('project', 'snapshot', 'all')").collect()}
    assert {v["total_cc"] for v in levels.values()} == {10}
    nodes = coupling.numbered(spark.createDataFrame([("s", "NS1"), ("s", "NS2")], "snapshot_id string, name string"), "name")
    links = spark.createDataFrame([("s", "NS1", "NS2", 2, 4), ("s", "NS1", "NS1", 2, 9), ("s", "NS1", "Out", 2, 9)], EDGE)
    assert [tuple(r) for r in coupling.graph_edges(links, nodes, 2, loops=False).collect()] == [("s", 0, 1, 4)]
    assert coupling.graph_edges(links, nodes, 2, loops=True).count() == 2


def test_missing_edges_are_appended_once(spark, edges):
    declared = spark.createDataFrame([("s", "App", "Library", 0, 1), ("s", "App", "New", 0, 1)], EDGE)
    assert coupling.missing_edges(declared, edges).where("to_entity = 'New'").count() == 1 and coupling.missing_edges(declared, edges).count() == 7


def test_summary_ties_go_to_the_earlier_layer_and_name(spark, edges):
    projects = spark.createDataFrame([("s", "App"), ("s", "Library")], "snapshot_id string, project_name string")
    got = coupling.coupling_summary(coupling.all_coupling(edges, projects), edges).collect()[0]
    assert (got["total_dependencies"], got["most_coupled"], got["most_dependent"], got["highest_consumer"]) == (4, "App.Core.Controller", "Library", "App")


def test_reference_changes_keep_case_rules(spark):
    refs = spark.createDataFrame([("b", "P", "Foo"), ("b", "P", "Keep"), ("h", "P", "foo"), ("h", "P", "Keep"), ("h", "P", "KEEP"), ("h", "P", " ")], "snapshot_id string, project string, ref string")
    pairs = spark.createDataFrame([("h", "b")], "head_snapshot_id string, base_snapshot_id string")
    got = {(r["ref"], r["outcome"]) for r in diff.reference_changes(refs, pairs, ["project"]).collect()}
    assert got == {("Foo", "removed"), ("foo", "added"), ("KEEP", "added"), ("Keep", "removed")}
    summary = diff.reference_summary(diff.reference_changes(refs, pairs, ["project"]), diff.reference_changes(refs.drop("project"), pairs)).collect()[0]
    assert (summary["packages_added"], summary["bcl_added"], summary["summary"]) == (2, 0, "`KEEP` 🆕, `foo` 🆕")


def test_project_diff_joins_without_case(spark):
    cols = "snapshot_id string, project_name string, " + ", ".join(f"{m} int" for m in diff.PROJECT_MEASURES)
    rows = [("b", "App", 1, 1, 5, 9, 0, 0, 1), ("h", "APP", 1, 1, 8, 9, 0, 0, None), ("b", "Gone", 1, 1, 1, 1, 1, 1, 1), ("h", "New", 2, 2, 2, 2, 2, 2, 2), ("h", None, 2, 2, 2, 2, 2, 2, 2)]
    pairs = spark.createDataFrame([("h", "b")], "head_snapshot_id string, base_snapshot_id string")
    got = by(diff.project_diff(spark.createDataFrame(rows, cols), pairs), "project")
    assert set(got) == {"APP", "Gone", "New"} and got["APP"]["total_cc_delta"] == 3 and got["Gone"]["is_removed"] and got["New"]["is_added"] and got["Gone"]["total_cc_delta"] == -1


def test_halstead_tokens_and_inheritance(spark):
    df = spark.createDataFrame([(1, "var x = a + 5; // gone + gone\nif (x > \"5\") return default;"), (2, None), (3, "")], "id long, code string")
    got = by(halstead(df, "code", ["id"]), "id")
    assert (got[1]["n1"], got[1]["total1"], got[1]["n2"], got[1]["total2"]) == (9, 10, 5, 6)
    assert got[2]["volume"] == 0 == got[3]["volume"]
    bases = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "Outside"), ("f", "")], "name string, base string")
    assert {r["name"]: r["depth"] for r in depth_of_inheritance(bases, "name", "base").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 1, "f": 0}


CC = [("", 1), ("if (a) b();", 2), ("if (a) b(); else c();", 2), ("if (a) { if (b) c(); }", 3), ("while (a) b();", 2), ("for (int i = 0; i < 3; i++) b();", 2), ("foreach (var x in y) b();", 2), ("do { b(); } while (a);", 2), ("switch (a) { case 1: b(); break; case 2: break; default: break; }", 4), ("try { a(); } catch (E e) { b(); }", 2), ("try { a(); } catch (E) { } catch { }", 3), ("return a && b;", 2), ("return a || b;", 2), ("return a ? b : c;", 2), ("return a ?? b;", 2), ("return a?.b;", 2), ("int? x = null;", 1)]


@pytest.mark.parametrize(("body", "want"), CC)
def test_complexity_of_bodies(body, want):
    assert frontend.measure([t for t, _ in frontend.lex(body)]).complexity == want


@pytest.mark.parametrize(("body", "want"), [("", 0), ("a();", 1), ("int x = 1; x++; return x;", 3), ("if (a) return 1; return 2;", 3), ("for (int i = 0; i < 3; i++) { a(); }", 2), ("do { a(); } while (b);", 2), ("using (var x = y) { a(); }", 2), ("lock (x) { throw e; }", 2), ("try { a(); } finally { b(); }", 3)])
def test_statements_of_bodies(body, want):
    assert frontend.measure([t for t, _ in frontend.lex(body)]).lines == want


def test_source_facts(spark):
    code = """using System.Text;
namespace A.B;
public class C<T> : Base, IThing {
    private int f = 3;
    public C(int a, string b) { f = a; }
    int Twice(int x) => x * 2;
    abstract void None();
    class Inner { void Go() { if (f > 1 && f < 3) { f++; } } }
}
record R(int X);
"""
    df = spark.createDataFrame([("x.cs", code), ("obj/y.cs", code), ("n.cs", None), ("e.cs", "")], "path string, content string")
    rows = [r.asDict() for r in frontend.source_facts(df).collect()]
    assert {r["name"] for r in rows if r["kind"] == "type"} == {"A.B.C", "A.B.C.Inner", "A.B.R"}
    methods = {r["name"]: r for r in rows if r["kind"] == "method"}
    assert set(methods) == {"A.B.C.C(int, string)", "A.B.C.Twice(int)", "A.B.C.None()", "A.B.C.Inner.Go()"}
    holders = lambda rows: [r[3] for r in rows if r[0] == "method" and r[2] == "A.B.C.Inner.Go()"]
    nested = "namespace A.B; class C { class Inner { void Go() { f++; } } void Own() { } }"
    assert holders(frontend.analyse("n.cs", nested)) == ["A.B.C.Inner", "A.B.C"] and holders(frontend.analyse("n.cs", nested, outer_too=False)) == ["A.B.C.Inner"]
    assert sum(r[0] == "method" and r[2] == "A.B.C.Own()" for r in frontend.analyse("n.cs", nested)) == 1
    assert (methods["A.B.C.Inner.Go()"]["complexity"], methods["A.B.C.Inner.Go()"]["lines"], methods["A.B.C.Inner.Go()"]["start_line"]) == (3, 2, 8)
    assert methods["A.B.C.None()"]["maintainability"] == 100 and methods["A.B.C.Twice(int)"]["lines"] == 1
    assert [r["name"] for r in rows if r["kind"] == "using"] == ["System.Text"]


def test_source_facts_of_generic_methods_attributes_and_statements():
    code = """using System;
namespace A;
[Serializable("x")]
public class C {
    T Load<T>(int x) { if (x > 1) { return f; } return g; }
    [Obsolete("x")] public void Foo() { f++; }
    [A, B(1)]
    [C(2)]
    public Map<K, List<V>> Twice<K, V>(K k) where K : new() => k;
    int[] g = new[] { 1 };
    public static bool operator >(C a, C b) { return true; }
}
"""
    methods = {r[2]: r[6:8] for r in frontend.analyse("x.cs", code) if r[0] == "method"}
    assert methods == {"A.C.Load<T>(int)": (2, 3), "A.C.Foo()": (1, 1), "A.C.Twice<K, V>(K)": (1, 1)}
    program = """#nullable enable
using System;
[assembly: X("y")]
var b = Make(1);
if (b > 1) { Console.WriteLine(Add(1, 2)); } else { b--; }
using var r = Open("x");
static int Add(int x, int y) => x + y;
T Get<T>(T t) where T : class { while (true) { t = null; } }
public enum E { A, B }
internal delegate void D(int x);
public sealed class K { void Go() { if (f) { f(); } } }
"""
    rows = frontend.analyse("p.cs", program)
    assert [r[2] for r in rows if r[0] == "type"] == ["K", "<Program>$"] and [r[2] for r in rows if r[0] == "using"] == ["System"]
    methods = {r[2]: r[4:8] for r in rows if r[0] == "method"}
    assert methods["<Program>$.Main(string[])"][:3] == (4, 8, 4) and methods["<Program>$.Add()"] == (7, 7, 1, 1) and methods["<Program>$.Get()"] == (8, 8, 2, 2) and set(methods) == {"K.Go()", "<Program>$.Main(string[])", "<Program>$.Add()", "<Program>$.Get()"}
    assert not any("Program" in r[2] for r in frontend.analyse("q.cs", "using A;\n#if X\nusing B;\n#endif\n[X]\npublic enum E { A }\npublic partial record R(int X);\nclass C { }\n}"))


def test_reference_edges(spark):
    one = "using B;\nnamespace A { class X : Base { B.Y y; Y z; Other.Y w; void M() { Y.Go(); Helper h; Unknown u; } } class Helper { X x; } }"
    two = "namespace B { class Y { } class Base { } } namespace C { class Y { } }"
    df = spark.createDataFrame([("1.cs", one), ("2.cs", two)], "path string, content string")
    got = {tuple(r) for r in frontend.reference_edges(frontend.source_facts(df)).collect()}
    assert got == {("A.X", "B.Y", 3, 2), ("A.X", "B.Base", 3, 1), ("A.X", "A.Helper", 3, 1), ("A.Helper", "A.X", 3, 1), ("A", "B", 2, 4)}


def test_project_files(spark, tmp_path):
    (tmp_path / "App").mkdir()
    (tmp_path / "App" / "App.csproj").write_text('<Project xmlns="http://x"><ItemGroup><PackageReference Include=" B "/><PackageReference Include="b"/><PackageReference Include=" "/><ProjectReference Include="..\\Lib\\Lib.Core.csproj"/><ProjectReference Include="..\\Other\\O.csproj"/></ItemGroup></Project>')
    found = files.source_files(spark, str(tmp_path), "*.csproj")
    assert [r["ref"] for r in files.project_items(found, "PackageReference").collect()] == ["B"]
    base = found.collect()[0]["path"].rsplit("/App/", 1)[0]
    known = spark.createDataFrame([(f"{base}/lib/lib.core.csproj", "TheLib")], "path string, project_name string")
    got = files.resolve_references(files.project_items(found, "ProjectReference"), known)
    assert {r["project"] for r in got.collect()} == {"TheLib", "O"}


def test_reports_round_trip(spark, tmp_path):
    body = {"solutionPath": "x", "projects": [{"name": "P", "types": [{"fullName": "N.T", "methods": [{"fullName": "N.T.M()", "cyclomaticComplexity": 3}]}]}], "unknown": 1}
    (tmp_path / "r.json").write_text(json.dumps(body, indent=1))
    rows = files.report_methods(files.read_reports(spark, str(tmp_path))).collect()
    assert [(r["project"], r["fullName"], r["cyclomaticComplexity"], r["startLine"]) for r in rows] == [("P", "N.T.M()", 3, None)]
    reports.write_json(spark.createDataFrame([(1, None)], "a int, b int"), str(tmp_path / "out"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"a": 1}]
    files.append_edges(spark.createDataFrame([("s", "a", "b", 0, 1)], EDGE), str(tmp_path / "e"))
    files.append_edges(spark.createDataFrame([("s", "a", "b", 0, 1)], EDGE), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    files.reset_edges(spark, str(tmp_path / "e"), EDGE)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [("s", rng.choice("abc"), rng.choice(["x", "y", ""]), 2, rng.choice([None, 1, 2])) for _ in range(300)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], EDGE).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    flat = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    flat.repartition(5).write.parquet(str(tmp_path / "edges"))
    stream = edge_stream(spark, str(tmp_path / "edges"), flat.schema, files_per_trigger=2)
    assert sorted(drain(stream).collect()) == sorted(running_edges(flat.where("to_entity != ''")).collect())


def test_compact_report(spark):
    snaps = spark.createDataFrame([("s", "x.sln", datetime(2025, 1, 1), "1", "Full", "abc", None, None, True), ("t", "y.sln", datetime(2025, 1, 1), "1", "Lightweight", None, None, None, False)], "snapshot_id string, solution_path string, analyzed_at timestamp, tool_version string, analysis_mode string, commit_sha string, branch_name string, remote_url string, is_dirty boolean")
    projects = spark.createDataFrame([("s", "B", 1, None), ("s", "A", 2, 3)], "snapshot_id string, n string, tc int, err int")
    got = {r["snapshot_id"]: json.loads(r["report"]) for r in reports.compact_reports(snaps, projects).collect()}
    assert got["s"] == {"v": 1, "p": "x.sln", "t": 1735689600000, "prj": [{"n": "A", "tc": 2, "err": 3}, {"n": "B", "tc": 1}], "gitSha": "abc", "gitDirty": True, "toolVer": "1", "hasCm": True}
    assert got["t"]["prj"] == [] and got["t"]["hasCm"] is False and "gitDirty" not in got["t"]


def test_compact_report_holds_graph_and_diagnostics(spark):
    snaps = spark.createDataFrame([(s, "x.sln", datetime(2025, 1, 1), "1", "Full", None, None, None, False) for s in "st"], "snapshot_id string, solution_path string, analyzed_at timestamp, tool_version string, analysis_mode string, commit_sha string, branch_name string, remote_url string, is_dirty boolean")
    projects = spark.createDataFrame([("s", "A", 1)], "snapshot_id string, n string, tc int")
    nodes = spark.createDataFrame([("s", 0, "A", 5), ("s", 1, 'B"\u2028', 0)], "snapshot_id string, node_id int, name string, loc int")
    edges = spark.createDataFrame([("s", 1, 0, 7)], "snapshot_id string, source int, target int, weight int")
    layer = reports.graph_document(nodes, edges, ["node_id", "name", "loc"])
    graphs = reports.graphs_of_layers(layer, layer.limit(0))
    found = [("s", 2, "A", "CS1", 3, 'no "x"\n\u2028', "a.cs", 4, 5), ("s", 1, None, "CS2", 2, None, "b.cs", None, 6), ("s", 10, "A", "CS3", 1, "m", "c.cs", 1, 1), ("s", 11, "A", "CS4", None, "m", "c.cs", 1, 1)]
    diagnostics = spark.createDataFrame(found, "snapshot_id string, pos bigint, project string, id string, severity int, message string, file string, line int, col_no int")
    got = {r["snapshot_id"]: json.loads(r["report"]) for r in reports.compact_reports(snaps, projects, graphs, diagnostics).collect()}
    empty = {"n": [], "e": []}
    assert got["s"]["g"] == {"p": {"n": [[0, "A", 5], [1, 'B"\u2028', 0]], "e": [[1, 0, 7]]}, "ns": empty}
    assert got["s"]["diag"] == {"e": 1, "w": 1, "i": 1, "d": [[None, "CS2", 2, None, "b.cs", None, 6], ["A", "CS1", 3, 'no "x"\n\u2028', "a.cs", 4, 5], ["A", "CS3", 1, "m", "c.cs", 1, 1], ["A", "CS4", 0, "m", "c.cs", 1, 1]]}
    assert got["t"]["g"] == {"p": empty, "ns": empty} and "diag" not in got["t"] and got["t"]["prj"] == []


def test_reports_of_the_tables_hold_all_edges_and_diagnostics(spark):
    m = Model(spark, MIDDLE)
    got = {r["snapshot_id"]: json.loads(r["report"]) for r in A.QUERIES["k2_compact_reports"](spark, MIDDLE).collect()}
    kept = m.diagnostics().join(m.snapshots().select("snapshot_id"), "snapshot_id", "left_semi")
    assert sum(len(r["diag"]["d"]) for r in got.values() if "diag" in r) == kept.count() > 0
    for layer, nodes, edges in (("p", "g4_project_nodes", "g4_project_edges"), ("ns", "g5_namespace_nodes", "g5_namespace_edges")):
        want = {}
        for r in A.QUERIES[edges](spark, MIDDLE).collect():
            want.setdefault(r["snapshot_id"], []).append([r["source"], r["target"], r["weight"]])
        assert (want or layer == "ns") and {s: sorted(r["g"][layer]["e"]) for s, r in got.items() if r["g"][layer]["e"]} == {s: sorted(e) for s, e in want.items() if s in got}
        assert sum(len(r["g"][layer]["n"]) for r in got.values()) == sum(r["snapshot_id"] in got for r in A.QUERIES[nodes](spark, MIDDLE).collect())
    assert {len(n) for r in got.values() for n in r["g"]["ns"]["n"]} == {11}


def small_model(spark):
    """One snapshot of two projects and two namespaces; the first uses the second at each level."""
    return SimpleNamespace(
        edges=lambda: spark.createDataFrame([("s", *r) for r in [("P", "Q", 0, 2), ("P", "Q", 0, 1), ("P", "Q", 0, 0), ("P.A", "Q.B", 2, 3), ("P.A", "Q.B", 2, 4), ("P.A", "P.A", 2, 9), ("Q.B", "System", 2, 1), ("P.A", "System.IO", 2, 1)]], EDGE),
        projects=lambda: spark.createDataFrame([("s", "Q", None), ("s", "P", 7), ("s", None, 1)], "snapshot_id string, project_name string, total_loc int"),
        types=lambda: spark.createDataFrame([(1, "s", "P", "P.A.T", "f", 1), (2, "s", "Q", "Q.B.U", "f", 1)], "type_id long, snapshot_id string, project string, full_name string, file_path string, depth_of_inheritance int"),
        methods=lambda: spark.createDataFrame([(1, "s", "P", 1, "P.A.T.M()", 3, 5, 80.0)], "method_id long, snapshot_id string, project string, type_id long, full_name string, cyclomatic_complexity int, lines_of_executable_code int, maintainability_index double"),
    )


def test_graph_of_a_report_has_both_layers_and_all_fields(spark):
    got = {r["snapshot_id"]: json.loads(r["graph"]) for r in A._graphs(small_model(spark)).collect()}
    assert got == {"s": {"p": {"n": [[0, "P", 7], [1, "Q", 0]], "e": [[0, 1, 3]]}, "ns": {"n": [[0, "P.A", 5, 3, 80.0, 1, 1, 2, 1, 0.67, 1], [1, "Q.B", 0, 0, 0.0, 1, 0, 0, 1, 0.0, 1]], "e": [[0, 1, 7]]}}}


def test_graph_layers_query_gives_both_layers(spark):
    got = [json.loads(r["graph"]) for r in A.QUERIES["k2_graph_layers"](spark, MIDDLE).collect()]
    assert {len(n) for g in got for n in g["p"]["n"]} == {3} and {len(n) for g in got for n in g["ns"]["n"]} == {11}
    assert sum(len(g["p"]["n"]) for g in got) == A.QUERIES["g4_project_nodes"](spark, MIDDLE).count()
    assert sum(len(g["ns"]["n"]) for g in got) == A.QUERIES["g5_namespace_nodes"](spark, MIDDLE).count()


def test_compact_projects_count_package_references(spark):
    names = spark.createDataFrame([("s", p, 1, 1, 1, 1, 1) for p in ("P", "Q", "R")], "snapshot_id string, project_name string, type_count int, method_count int, total_cc int, total_loc int, max_dit int")
    ties = coupling.project_coupling(spark.createDataFrame([("s", "P", "Q", 0, 1)], EDGE), names.where("project_name != 'R'"))
    mi = spark.createDataFrame([("s", "P", 80.0)], "snapshot_id string, project string, avg_mi double")
    found = spark.createDataFrame([("s", "P", 1, 0)], "snapshot_id string, project string, errors int, warnings int")
    texts = {"P": ["System.Text.Json", "Microsoft.Extensions.Options", "Tarnval", "tarnval"], "R": ["SystemX"]}
    read = spark.createDataFrame([(p, "<P>" + "".join(f'<PackageReference Include="{r}"/>' for r in refs) + "</P>") for p, refs in texts.items()], "path string, content string")
    refs = files.project_items(read, "PackageReference").select(F.lit("s").alias("snapshot_id"), F.col("path").alias("project"), "ref")
    counts = lambda df: {r["n"]: (r["id"], r["idx"], r["ed"], r["edb"], r["edp"]) for r in df.collect()}
    assert counts(reports.compact_projects(names, ties, mi, found, refs)) == {"P": (1, 0, 3, 2, 1), "Q": (0, 1, 0, 0, 0), "R": (0, 0, 1, 0, 1)}
    assert counts(reports.compact_projects(names, ties, mi, found)) == {"P": (1, 0, 0, 0, 0), "Q": (0, 1, 0, 0, 0), "R": (0, 0, 0, 0, 0)}


def test_all_measures_of_a_project_are_compared(spark):
    measures = [*diff.PROJECT_MEASURES, *diff.FURTHER_MEASURES]
    rows = [("a", "P", *[1] * 7, 70.06, 2, 1, 0.666, 0, 0, 0), ("b", "p", *[3] * 7, 60.0, 1, 1, 0.5, 3, 2, 1), ("b", "Q", *[2] * 7, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "snapshot_id string, project_name string, " + ", ".join(f"{m} {'double' if m in ('mi', 'dr') else 'long'}" for m in measures))
    pairs = spark.createDataFrame([("b", "a")], "head_snapshot_id string, base_snapshot_id string")
    got = by(diff.project_diff(df, pairs, diff.FURTHER_MEASURES), "project")
    assert len(measures) == 14 and [got["p"][f"{m}_delta"] for m in measures] == [2] * 7 + [-10.1, -1, 0, -0.17, 3, 2, 1]
    assert got["Q"]["is_added"] and got["Q"]["mi_delta"] == 0 and set(by(diff.project_diff(df, pairs), "project")) == {"p", "Q"}


def test_compared_rows_hold_every_part(spark):
    """A pair without anything else has zeros; details count once."""
    snaps = spark.createDataFrame([("a", "x", "Full"), ("b", "x", "full"), ("c", "x", "Lightweight")], "snapshot_id string, solution_path string, analysis_mode string")
    for c in ("analyzed_at", "commit_sha", "branch_name"):
        snaps = snaps.withColumn(c, F.lit(None).cast("string"))
    pairs = spark.createDataFrame([("b", "a"), ("c", "b")], "head_snapshot_id string, base_snapshot_id string")
    meta = diff.diff_metadata(snaps, pairs)
    assert {r["head_snapshot_id"]: r["has_complexity"] for r in meta.collect()} == {"b": True, "c": False}
    kinds = ", ".join(f"{n} {'double' if n == 'avg_mi' else 'long'}" for n in diff.TOTALS)
    totals = diff.totals_diff(spark.createDataFrame([("a", *[1] * 9, 70.0), ("b", *[3] * 9, 60.5)], f"snapshot_id string, {kinds}"), pairs)
    rows = [("b", "P", False, False, *[0] * 14), ("b", "Q", True, False, *[1] * 14), ("b", "R", False, False, *[0] * 13, 2)]
    names = [f"{m}_delta" for m in [*diff.PROJECT_MEASURES, *diff.FURTHER_MEASURES] if m != "warning_count"] + ["warning_count_delta"]
    projects = spark.createDataFrame(rows, "head_snapshot_id string, project string, is_added boolean, is_removed boolean, " + ", ".join(f"{n} int" for n in names))
    found = spark.createDataFrame([("b", 4)], "head_snapshot_id string, added_error long")
    presence = spark.createDataFrame([("b", "x", "added"), ("b", "y", "removed"), ("b", "z", "added")], "head_snapshot_id string, ref string, outcome string")
    got = by(diff.compare(meta, totals, projects, found, presence), "head_snapshot_id")
    assert [got["b"][c] for c in ("avg_mi_delta", "cc_delta", "projects_added", "projects_removed", "projects_changed", "added_error", "new_to_solution", "removed_from_solution")] == [-9.5, 2, 1, 0, 1, 4, 2, 1]
    assert [got["c"][c] for c in ("avg_mi_delta", "cc_delta", "projects_added", "added_error", "new_to_solution")] == [-60.5, -3, 0, 0, 0]


def test_packages_of_the_fixture_and_their_changes(spark):
    """Of five packages three are the framework's; a target that is a listed project is none."""
    packages = ["System", "System.CommandLine", "Microsoft.Extensions.Logging", "LibGit2Sharp", "Company.Systematic"]
    refs = spark.createDataFrame([("h", "P", r) for r in [*packages, "Library", "System", " "]] + [("b", "p", "Old"), ("h", "New", "Old")], "snapshot_id string, project string, ref string")
    projects = spark.createDataFrame([("h", "P"), ("h", "Library"), ("b", "P"), ("b", None)], "snapshot_id string, project_name string")
    own = references.package_references(refs, projects)
    assert {r["n"]: (r["ed"], r["edb"], r["edp"]) for r in references.package_counts(own.where("project = 'P'")).collect()} == {"P": (5, 3, 2)}
    pairs = spark.createDataFrame([("h", "b")], "head_snapshot_id string, base_snapshot_id string")
    changes = references.external_changes(own, pairs)
    both = references.of_both_snapshots(changes, references.present_projects(projects, refs), pairs)
    got = {(r["project"], r["ref"], r["outcome"], r["is_bcl"]) for r in both.collect()}
    assert got == {("P", r, "added", r.startswith(("System", "Microsoft."))) for r in packages} | {("p", "Old", "removed", False)}
    assert changes.count() == 7
    totals = references.added_totals(both.where("outcome = 'added'")).collect()[0]
    assert (totals["projects"], totals["total_added"], totals["unique_added"], totals["framework_added"]) == (1, 5, 5, 3)


def test_depth_by_doubling(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(300)]
    rows = [*chain, ("n299", None), ("x", "elsewhere"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("on", "c1"), ("empty", ""), (None, "n1"), ("two", "n5"), ("two", "n9")]
    got = {r["name"]: r["depth"] for r in depth_of_inheritance(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()}
    assert got == {**{f"n{i}": i for i in range(300)}, "x": 1, "c1": None, "c2": None, "c3": None, "on": None, "empty": 0, "two": 6}
    assert depth_of_inheritance(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_strings_of_all_kinds_are_lexed():
    code = 'var a = @"C:\\"" x" + $"hi {b}" + """raw "q" text""" + "p\\"q"; // "no"'
    assert token_counts(code) == (3, 4, 5, 4)  # = + ;  and  var a, the verbatim and the plain string
    assert token_counts(None) == token_counts("") == (0, 0, 0, 0) and token_counts("default") == (1, 0, 1, 0)


def test_solutions_of_both_formats_and_dispatch(spark, tmp_path):
    text = 'Project("{A}") = "App", "src\\App\\App.csproj", "{1}"\nEndProject\nProject("{A}") = "Folder", "Folder", "{2}"\nEndProject\nProject("{B}")="V","V.vbproj","{3}"\nProject("{A}") = "App", "src\\App\\App.csproj", "{1}"\n'
    (tmp_path / "one.sln").write_text(text)
    (tmp_path / "two.slnx").write_text('<Solution><Folder Name="/src/"><Project Path="src/B.Core/B.Core.csproj" Type="x"/></Folder><Project Path="c.fsproj"/></Solution>')
    got = [(r["project_name"], r["project_path"]) for name in ("one.sln", "two.slnx") for r in files.read_projects(spark, str(tmp_path / name)).collect()]
    assert got == [("App", "src\\App\\App.csproj"), ("B.Core", "src/B.Core/B.Core.csproj")]
    assert [tuple(r) for r in files.read_projects(spark, "/x/P.Q.csproj").collect()] == [("/x/P.Q.csproj", "P.Q", "/x/P.Q.csproj")]
    with pytest.raises(ValueError):
        files.read_projects(spark, "/x/readme.md")


def test_state_of_a_repository(tmp_path):
    assert versions.repository_state(str(tmp_path)) is None or (tmp_path / ".git").exists() is False
    own = tmp_path / ".git"
    (own / "refs/heads/feature").mkdir(parents=True)
    (own / "HEAD").write_text("ref: refs/heads/feature/x\n")
    (own / "config").write_text('[core]\n\tbare = false\n[remote "up"]\n\turl = no\n[remote "origin"]\n\tfetch = +x\n\turl = ssh://h/r.git\n[branch "b"]\n')
    sha = "0123456789" * 4
    assert versions.repository_state(str(tmp_path))["branch_name"] is None
    (own / "packed-refs").write_text(f"# pack-refs with: peeled\n{sha} refs/heads/feature/x\n^{sha}\n")
    (tmp_path / "src").mkdir()
    state = versions.repository_state(str(tmp_path / "src"))
    assert (state["commit_sha"], state["short_sha"], state["branch_name"], state["remote_url"]) == (sha, "0123456", "feature/x", "ssh://h/r.git")
    (own / "HEAD").write_text("f" * 40)
    assert versions.repository_state(str(tmp_path))["branch_name"] == "detached-fffffff"


def test_a_replaced_measure_changes_what_rests_on_it(spark):
    bodies = spark.createDataFrame([(1, 4, 0, 3, 2, 10, 10, None, True, True), (2, 1, 9, 3, 2, 10, 10, 2, True, False), (3, 9, 9, 9, 9, 9, 9, 1, False, False)], "id int, branches int, statements int, n1 int, n2 int, total1 int, total2 int, depth int, has_body boolean, is_expression boolean")
    plain = by(Calculator().measured(bodies, ["id"]), "id")
    assert (plain[1]["complexity"], plain[1]["lines"], plain[1]["maintainability"], plain[1]["depth"]) == (5, 1, 100.0, 0)
    assert (plain[3]["complexity"], plain[3]["lines"], plain[3]["volume"], plain[3]["maintainability"], plain[3]["effort"]) == (1, 0, 0.0, 100.0, 0.0)

    class Double(Calculator):
        def complexity(self):
            return super().complexity() * 2

    twice = by(Double().measured(bodies, ["id"]), "id")
    assert twice[2]["complexity"] == 4 and twice[2]["maintainability"] == pytest.approx(plain[2]["maintainability"] - 0.23 * 2 * 100 / 171)


def test_reports_are_read_by_names_in_any_case(spark, tmp_path):
    text = {"SolutionPath": "x", "PROJECTS": [{"Name": "P", "types": [{"FullName": "T", "Methods": [{"fullname": "T.M()", "CyclomaticComplexity": 3}]}], "Diagnostics": {"ErrorCount": 2}}], "Odd": {"Name": 1}}
    (tmp_path / "a.json").write_text(json.dumps(text, indent=2))
    (tmp_path / "b.json").write_text("null")
    got = {r["path"].rpartition("/")[2]: r for r in files.read_reports(spark, str(tmp_path)).collect()}
    assert got["a.json"]["solutionPath"] == "x" and got["a.json"]["projects"][0]["diagnostics"]["errorCount"] == 2 and got["b.json"]["projects"] is None
    assert [(r["project"], r["type_name"], r["fullName"], r["cyclomaticComplexity"]) for r in files.report_methods(files.read_reports(spark, str(tmp_path))).collect()] == [("P", "T", "T.M()", 3)]


def test_full_reports_read_back_whole(spark):
    m = Model(spark, MIDDLE)
    none = spark.createDataFrame([("snap-00000001", "P.Q", "Tarnval")], "snapshot_id string, project string, ref string")
    written = reports.full_reports(m.snapshots(), m.projects(), m.types(), m.methods(), m.diagnostics(), none, none.limit(0))
    read = written.select(F.from_json("report", files.REPORT).alias("r")).select("r.*").collect()
    kept = m.diagnostics().join(m.snapshots().select("snapshot_id"), "snapshot_id", "left_semi")
    assert sum(len(p["diagnostics"]["diagnostics"]) for r in read for p in r["projects"] if p["diagnostics"]) == kept.count() > 0
    assert {r["analysisMode"] for r in read} == {0, 1} and all(r["gitInfo"] for r in read) and any(r["analyzedAt"].microsecond for r in read)


def test_durable_tables_are_removed_on_release(spark, edges):
    kept = durable(edges)
    folder = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert Path(folder).exists() and release() == 0 and not Path(folder).exists()


def test_a_shared_checkpoint_folder_is_required_off_local():
    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(far)


def test_a_retried_batch_of_edges_doubles_nothing(spark, tmp_path, edges):
    path = str(tmp_path / "edges")
    for _ in range(2):
        files.append_edges(edges, path, "7")
    files.append_edges(edges, path, "8")
    assert spark.read.parquet(path).count() == 2 * edges.count()


def comparison(**more):
    totals = {f"{s}_{n}": 0 for s in ("base", "head") for n in ("projects", "types", "methods", "cc", "loc", "errors", "warnings", "info")} | {f"{n}_delta": 0 for n in ("projects", "types", "methods", "cc", "loc", "errors", "warnings")}
    totals |= {"base_errors": 10, "head_errors": 3, "errors_delta": -7, "base_warnings": 5, "head_warnings": 15, "base_avg_mi": 85.0, "head_avg_mi": 70.0, "avg_mi_delta": -15.0}
    items = {"added": [{"severity": 1, "id": "X", "message": "a|b", "line": 1, "col_no": 2, "file": "f"}, {"severity": 0, "id": "H", "message": "m", "line": 1, "col_no": 2, "file": "f"}]}
    projects = [
        {"project": p, "is_added": False, "is_removed": False, "base_mi": 80.0, "head_mi": 80.0 + d, "mi_delta": d, "total_cc_delta": c, "total_loc_delta": 0, "warning_count_delta": w} for p, d, c, w in (("P", 0.0, 60, -1), ("Q", -6.04, 0, 0), ("Same", 0.0, 0, 0))
    ]
    return {
        "base": {"commit_sha": "0123456789", "analysis_mode": "Full"}, "head": {"commit_sha": "", "analysis_mode": "Full"}, "totals": totals, "diagnostics": {}, "items": items, "projects": projects,
        "references": [{"project": f"p{i}", "added": ["A"] * (i % 3)} for i in range(20)], "externals": [{"project": "E", "bcl": ["System"], "packages": ["B", "C", "D", "E|x"], "delta": 0}], "fresh": ["a"],
    } | more


def test_sections_of_the_markdown_report_in_order():
    text = reports.render_markdown(**comparison())
    heads = [line for line in text.split("\n") if line.startswith("###") and not line.startswith("####")]
    assert heads == ["### Diagnostics", "### Project References Changes", "### NuGet Dependencies Changes", "### Maintainability Changes", "### Overall Metrics"]
    for part in (
        "Base: `0123456`", "Head: `unknown`", "| Errors | 10 | 3 | 7 | 0 |", "⚠️ **10**", "🔴 **-15.0**", "| info | X | a\\|b | 1:2 | f |", "...and 3 more project(s)", "✅ -1",
        "Added direct project refs in 13 project(s), 19 total change(s), 1 unique.", "- `p2` → `A` 🆕, `A` 🆕", "- `E` → BCL: `System`; Packages: `B`, `C`, `D`, +1 more", "1 BCL, 4 package.",
        "| Project | MI (Base) | MI (Head) | Delta | Complexity Δ | LOC Δ | Warnings Δ |\n| --- | ---: | ---: | ---: | ---: | ---: | ---: |\n| Q | 80.0 | 74.0 | ⚠️ **-6.0** | 0 | 0 | 0 |\n| P | 80.0 | 80.0 | 0 | +60 | 0 | ✅ -1 |",
    ):
        assert part in text, part
    assert "| hidden |" not in text and "None" in text and "Same" not in text
    light = reports.render_markdown(**comparison(head={"analysis_mode": "Lightweight"}, references=[], externals=[]), least_level="HIDDEN")
    assert "### Maintainability" not in light and "Avg Maintainability" not in light and "| hidden |" in light and "References" not in light


def test_a_comparison_agrees_with_the_queries_over_all_pairs(spark):
    row = A.QUERIES["d1_compare"](spark, MIDDLE).where("added_warning > 0 and removed_warning > 0 and has_complexity").orderBy(F.desc("new_to_solution"), "head_snapshot_id").first()
    got = comparison_of(Model(spark, MIDDLE), row["base_snapshot_id"], row["head_snapshot_id"])
    counted = {"error": "errors", "warning": "warnings", "info": "info"}
    assert all(got["diagnostics"][f"{o}_{counted[x]}"] == row[f"{o}_{x}"] for o in ("added", "removed", "changed") for x in counted)
    assert all(got["totals"][c] == row[c] for c in ("projects_delta", "cc_delta", "avg_mi_delta", "errors_delta"))
    assert len(got["fresh"]) == row["new_to_solution"] and sum(p["is_added"] for p in got["projects"]) == row["projects_added"]
    assert sum(i["severity"] == 2 for i in got["items"]["added"]) == row["added_warning"] and sum(i["severity"] == 2 for i in got["items"]["removed"]) == row["removed_warning"]
    text = reports.render_diff("markdown", got)
    assert "### Diagnostics" in text and "### Overall Metrics" in text and "### NuGet Dependencies Changes" in text
    assert json.loads(reports.render_diff("json", got))["totals"]["cc_delta"] == row["cc_delta"] and "<nav>" in reports.render_diff("html", got)


def test_forms_of_a_comparison():
    assert json.loads(reports.render_diff("json", comparison()))["totals"]["base_errors"] == 10
    assert "Errors: 10 -> 3 (-7)" in reports.render_diff("summary", comparison()) and reports.render_diff("markdown", comparison(), max_projects=1).count("- `p") == 1
    assert "coupling" in reports.render_diff("html", comparison()) and 'id="coupling"' not in reports.render_diff("html", comparison(base={"analysis_mode": "Lightweight"}))
    with pytest.raises(ValueError):
        reports.render_diff("pdf", comparison())
    assert reports.level_of("WARNING") == 2 and reports.level_of("odd") == 1 and reports.mode_of("FULL") == 0
    with pytest.raises(ValueError):
        reports.mode_of("odd")
    assert reports.warning_lines([str(i) for i in range(13)])[-2:] == ["9", "... and 3 more"] and reports.warning_lines(["a"]) == ["a"]


def test_rendered_texts():
    assert reports.default_filename("0123456789", "feature/x", "compact") == "0123456-feature_x.slr" and reports.default_filename(None, None, "odd", datetime(2025, 1, 2)) == "report-2025-01-02-000000.json"
    page = reports.render_html("T<", datetime(2025, 1, 1), '{"a":"</script>@WHEN@"}', "s")
    assert "</script>\"" not in page and "@TITLE@" not in page and "http" not in page and "</script>@WHEN@" not in page and "@WHEN@" in page


def test_paging_search_and_order(spark):
    df = spark.createDataFrame([(i, f"Name{i}", None) for i in range(250)], "id int, name string, other string")
    assert [r["id"] for r in rollup.page(df, [F.asc("id")], 3).collect()] == list(range(200, 250))
    assert df.where(rollup.contains_anywhere(["id", "name", "other"], "NAME24")).count() == 11
    mixed = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "x string")
    assert [r["x"] for r in mixed.orderBy(*rollup.mixed_order("x")).collect()] == ["9", "10", "a", "b"]
