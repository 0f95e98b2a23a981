"""The core's training-data operators against brute force on whole small tables and on edge cases."""

import json
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import blocked, dense_totals, drift, nested, snapshot_diff
from plumbline.operators.snapshot_pairs import consecutive_snapshots, snapshot_roles
from plumbline.operators.strict_json import read_object
from plumbline.plans import pipeline_queries as queries
from plumbline.session import distinct_by
from tests.conftest import MIDDLE, SMALL


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- 1: nested records


def walk(value):
    kinds = {"prj": ("ns", "types"), "ns": ("types",), "types": ("m",), "m": ()}

    def go(item, fields, path):
        for field in fields:
            held = item.get(field)
            for i, x in enumerate(held if isinstance(held, list) else [held]):
                if isinstance(x, dict):
                    at = f"{path}.{field}[{i}]".lstrip(".")
                    yield at, path
                    yield from go(x, kinds[field], at)

    return list(go(value, ("prj",), ""))


def loaded(text):
    try:
        value = json.loads(text or "")
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def test_p1_found_is_every_object_of_every_payload(spark):
    table = pq.read_table(f"{MIDDLE}/compact_reports.parquet").to_pylist()
    want = Counter((r["report_id"], *x) for r in table if (v := loaded(r["payload"])) is not None for x in walk(v))
    assert Counter(rows(queries.p1_found(spark, MIDDLE))) == want


@pytest.mark.parametrize("payload", [None, "", "  ", "[]", "3", "null", '{"prj":[{}', '{"prj":[{}]} x', '{"prj":[{"a":NaN}]}', "<html>", '{"a":' * 50_000 + "1" + "}" * 49_999])
def test_unreadable_payloads_give_no_rows(payload):
    assert nested.shred_one(1, payload) == []


def test_irregular_shapes_keep_positions_and_content():
    found = nested.shred_one(7, '{"prj":[null,{"n":"a","ns":{"types":[3,{"m":null}]},"types":"odd"},{"n":"\\ud800"}]}')
    assert {(r[2], r[3]) for r in found} == {("prj[1]", ""), ("prj[1].ns[0]", "prj[1]"), ("prj[1].ns[0].types[1]", "prj[1].ns[0]"), ("prj[2]", "")}
    bodies = {r[2]: json.loads(r[8]) for r in found}
    assert bodies["prj[1]"]["types"] == "odd" and bodies["prj[1].ns[0]"]["types"]["rest"] == {"0": 3}


def test_identities_ignore_key_order_and_see_depth():
    one = nested.shred_one(1, '{"prj":[{"n":"a","types":[{"n":"t","cc":1}]},{"types":[{"cc":1,"n":"t"}],"n":"a"},{"n":"a","types":[{"n":"t","cc":2}]}]}')
    by = {r[2]: r[6] for r in one}
    assert by["prj[0]"] == by["prj[1]"] != by["prj[2]"]
    assert by["prj[0].types[0]"] == by["prj[1].types[0]"] != by["prj[2].types[0]"]


def test_flat_tables_keep_every_occurrence_and_store_objects_once(spark):
    data = [(i, '{"prj":[{"n":"same","tc":"x"},{"n":"same","tc":"x"}]}', "clash") for i in range(50)]
    bridge = nested.shred(spark.createDataFrame(data, "report_id long, payload string, level string"))
    assert nested.object_store(bridge).count() == 1
    flat = nested.flat_table(bridge, "project")
    assert flat.count() == 100 and rows(flat.select("name", "type_count").distinct()) == [("same", None)]


def test_a_common_object_is_spread_over_salts(spark, monkeypatch):
    monkeypatch.setattr(nested, "HOT", 50)
    data = [(i, '{"prj":[{"n":"stock","cc":1},{"n":"own%d","cc":%d}]}' % (i, i)) for i in range(200)]
    flat = nested.flat_table(nested.shred(spark.createDataFrame(data, "report_id long, payload string")), "project")
    got = Counter((r["name"], r["total_cc"]) for r in flat.collect())
    assert got == Counter({("stock", 1): 200} | {(f"own{i}", i): 1 for i in range(200)})


# ---- 3: drift


def spelled_equal(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return a == b
    if isinstance(b, str):
        a, b = b, a
    if isinstance(a, str):
        try:
            a = json.loads(a.lower() if a.lower() in ("true", "false") else a)
        except ValueError:
            return False
        if not isinstance(a, (int, float)):
            return False
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    return a == b and (isinstance(a, (int, float)) == isinstance(b, (int, float)))


def brute_drift(table):
    kind = lambda v: drift.json_type(v)
    feeds = defaultdict(dict)
    for r in sorted(table, key=lambda r: -r["report_id"]):
        if (v := loaded(r["payload"])) is not None:
            feeds[r["feed"]][r["seq_no"]] = {k: x for k, x in v.items() if k not in drift.IGNORED}
    out = []
    for feed, files in feeds.items():
        order = sorted(files)
        first, last = {}, {}
        for s in order:
            for k in files[s]:
                first.setdefault(k, s)
                last[k] = s
        source = {}
        for i, s in enumerate(order[1:], 1):
            gone = sorted(k for k in last if last[k] == order[i - 1])
            came = sorted(k for k in first if first[k] == s)
            for old in list(gone):
                for new in came:
                    a, b = files[order[i - 1]][old], files[s][new]
                    if a is not None and b is not None and spelled_equal(a, b):
                        out.append((feed, s, new, "renamed", old))
                        source[new] = old
                        gone.remove(old)
                        came.remove(new)
                        break
            out.extend((feed, s, k, "removed", "") for k in gone)
            out.extend((feed, s, k, "added", "") for k in came)
        known = {}
        for s in order:
            for k, v in files[s].items():
                if v is not None:
                    before = known.get(k, known.get(source.get(k)) if first[k] == s else None)
                    if before and before != kind(v):
                        out.append((feed, s, k, "retyped", ""))
            known |= {k: kind(v) for k, v in files[s].items() if v is not None}
    return Counter(out)


@pytest.mark.parametrize("folder", [SMALL, MIDDLE, "/root/testdata/sf0.1"])
def test_p3_found_equals_brute_force(spark, folder):
    table = pq.read_table(f"{folder}/compact_reports.parquet").to_pylist()
    got, want = Counter(rows(queries.p3_found(spark, folder))), brute_drift(table)
    assert got == want and want


def test_drift_over_block_borders_and_a_hot_feed(spark):
    data = []
    for i in range(9000):
        body = {"a": i % 5000} if i < 4097 else {"b": (i - 1 if i == 4097 else i) % 5000}
        data.append((i, "hot", i, json.dumps(body)))
    data += [(10_000 + i, None, i, "{}") for i in range(3)] + [(20_000, "one", 1, '{"z":1}'), (20_001, "one", None, '{"y":1}')]
    df = spark.createDataFrame(data, "report_id long, feed string, seq_no int, payload string")
    assert rows(drift.drift_events(drift.ingest(df))) == [("hot", 4097, "b", "renamed", "a")]


def test_ingest_enforces_types_and_rescues_the_rest(spark):
    data = [
        (1, "f", 1, '{"v":1,"hasCm":"true","l":[1],"extra":{ "b":1.0, "c" : 1e400},"n":"12"}'),
        (2, "f", 2, '{"ver":"2","hasCm":7,"l":"x","n":13,"v":9223372036854775808}'),
        (3, "f", 3, '{"v":null,"n":"no","p":"\\ud800","\\ud800":1,"q\\"]":0.10}'),
        (4, "f", 4, ""),
    ]
    df = spark.createDataFrame(data, "report_id long, feed string, seq_no int, payload string")
    got = {r["report_id"]: r for r in drift.ingest(df).withColumn("shown", drift.rescued_json()).collect()}
    assert len(got) == 3 and (got[1]["v"], got[1]["hasCm"], got[1]["l"]) == (1, None, "[1]")
    assert got[1]["_rescued"] == {"hasCm": '"true"', "extra": '{ "b":1.0, "c" : 1e400}', "n": '"12"'}
    assert got[1]["shown"] == '{"extra":{ "b":1.0, "c" : 1e400},"hasCm":"true","n":"12"}'
    assert got[2]["_rescued"] == {"ver": '"2"', "hasCm": "7", "l": '"x"', "n": "13", "v": "9223372036854775808"}
    assert got[3]["_rescued"] == {"v": "null", "n": '"no"', "p": '"\\ud800"', '"\\ud800"': "1", 'q"]': "0.10"}
    assert json.loads(got[3]["shown"])['q"]'] == 0.1


def test_promotion_replays_and_leaves_the_rest_as_it_was(spark):
    payloads = ['{"n":"12","a":1.0}', '{"n":13,"a":1.10}', '{"n":"no","a":[1.0, 2]}', '{"n":null,"m":5}', '{"n":2.0,"m":7}', '{"m":" 8 "}', "{}"]
    df = spark.createDataFrame([(i, "f", i, t) for i, t in enumerate(payloads)], "report_id long, feed string, seq_no int, payload string")
    got = {r["report_id"]: (r["n"], r["_rescued"]) for r in drift.promote(drift.ingest(df, {}), "n", "bigint", ["m"]).collect()}
    assert got == {
        0: (12, {"a": "1.0"}),
        1: (13, {"a": "1.10"}),
        2: (None, {"n": '"no"', "a": "[1.0, 2]"}),
        3: (5, {"n": "null"}),
        4: (2, {"m": "7"}),
        5: (8, {}),
        6: (None, {}),
    }


def test_casts_of_rescued_values(spark):
    cases = [
        ('"2025-01-02T03:04:05Z"', "millis", 1735787045000), ("1735787045.25", "millis", 1735787045250), ("1735787045000", "millis", 1735787045000), ('"soon"', "millis", None),
        ("1.5", "bigint", None), ('"v2"', "bigint", None), ("1e3", "bigint", None), ("99999999999999999999", "bigint", None), ("true", "bigint", None), ("null", "bigint", None),
        ('"Yes"', "boolean", True), ("0", "boolean", False), ("2", "boolean", None), ("1.4", "string", "1.4"), ('"a\\n\\"b"', "string", 'a\n"b'), ('{"a":1}', "string", None), ("null", "string", None),
        ("[ 1 ]", "json", "[ 1 ]"), ("3", "json", "3"), ("null", "json", None), ('"1.5"', "double", 1.5),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    kinds = sorted({c[1] for c in cases})
    got = {r["i"]: r for r in df.select("i", *[drift.cast_json(F.col("raw"), k).alias(k) for k in kinds]).collect()}
    assert [got[i][k] for i, (_, k, _) in enumerate(cases)] == [w for _, _, w in cases]


def test_names_are_learned_from_renames(spark):
    events = [("f", 2, "ver", "renamed", "v"), ("g", 2, "ver", "renamed", "v"), ("h", 3, "fmt", "renamed", "ver"), ("h", 3, "odd", "renamed", "v"), ("h", 4, "odd", "renamed", "p"), ("h", 4, "x", "renamed", "y"), ("h", 5, "z", "added", "")]
    df = spark.createDataFrame(events, "feed string, seq_no int, field_name string, drift_kind string, old_field_name string")
    assert drift.learned_names(df, ["v", "p"]) == {"v": ["ver", "fmt"], "p": []}
    assert drift.learned_names(df.limit(0), ["v"]) == {"v": []}


def brute_names(pairs, fields):
    """Names by field from all renames, every round over all names."""
    links = defaultdict(Counter)
    for a, b in pairs:
        links[a][b] += 1
        links[b][a] += 1
    of, found = {f: f for f in fields}, {f: [] for f in fields}
    while True:
        new = {}
        for name in links.keys() - of.keys():
            votes = Counter()
            for other, n in links[name].items():
                votes[of.get(other)] += n
            del votes[None]
            for field, n in votes.items():
                if 2 * n > links[name].total():
                    new[name] = field
                    found[field].append((-n, name))
        if not new:
            return {f: [name for _, name in sorted(names)] for f, names in found.items()}
        of |= new


def renames(spark, pairs):
    return spark.createDataFrame([("f", i, b, "renamed", a) for i, (a, b) in enumerate(pairs)], "feed string, seq_no int, field_name string, drift_kind string, old_field_name string")


def test_names_are_learned_from_any_number_of_renames(spark):
    """Rare renames count beside 12,000 frequent ones, and of a name's many renames all do."""
    pairs = [(f"x{i}", f"y{i}") for i in range(12_000)] * 2 + [("v", "ver"), ("ver", "fmt"), ("v", "ver"), ("p", "odd")] + [("odd", f"z{i:05}") for i in range(3)]
    assert drift.learned_names(renames(spark, pairs), ["v", "p"]) == {"v": ["ver", "fmt"], "p": []} == brute_names(pairs, ["v", "p"])


@pytest.mark.parametrize("most", [0, 40, 10_000])
def test_names_learned_over_tables_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(drift, "PAIRS", most)
    rng = random.Random(5)
    chain = [(a, b) for i in range(6) for a, b in [("v", f"c{i + 1}"), (f"c{i}", f"c{i + 1}")]]
    pairs = [("v", "c0"), ("v", "c0"), *chain] + [(rng.choice(["v", "p", f"n{rng.randrange(40)}"]), f"n{rng.randrange(40)}") for _ in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b]
    want = brute_names(pairs, ["v", "p"])
    assert {f"c{i}" for i in range(7)} <= set(want["v"]) and len(want["p"]) > 1
    assert drift.learned_names(renames(spark, pairs), ["v", "p"]) == want


@pytest.mark.parametrize("most", [0, 10_000])
def test_joined_names_fill_the_table_as_literal_ones_do(spark, monkeypatch, most):
    pairs = [("v", f"n{i}") for i in range(20) for _ in range(1 + i % 3)] + [("p", "q"), ("n7", "m"), ("x", "y")]
    payloads = ['{"v":1,"n2":2}', '{"n2":"3","n1":4,"n0":5,"q":"s"}', '{"n2":"no","n11":6}', '{"m":7,"x":8}', '{"v":null,"n1":1.5,"n0":9}', "{}", '{"q":1,"p":"t"}', '{"n2":"3","n1":4,"n0":5,"q":"s"}']
    files = drift.ingest(spark.createDataFrame([(i, "f", i, t) for i, t in enumerate(payloads)], "report_id long, feed string, seq_no int, payload string"), {"v": "bigint", "p": "string"})
    build = lambda: drift.consistent_table(files, renames(spark, pairs), {"v": "bigint", "p": "string"}, {})
    literal = build()
    monkeypatch.setattr(drift, "PAIRS", most)
    monkeypatch.setattr(drift, "FEW_NAMES", 0)
    joined = build()
    take = lambda df: {r["report_id"]: (r["v"], r["p"], r["_rescued"]) for r in df.collect()}
    want = take(literal)
    assert want[1] == (3, "s", {"n1": "4", "n0": "5"}) and want[2] == (6, None, {"n2": '"no"'}) and want[3] == (7, None, {"x": "8"}) and len(want) == 8
    assert joined.columns == literal.columns and take(joined) == want


def test_consistent_table_is_whole(spark):
    """Every spelled time is a time, and what no column takes is in the rescued text with its own spelling."""
    table = {r["report_id"]: v for r in pq.read_table(f"{MIDDLE}/compact_reports.parquet").to_pylist() if (v := loaded(r["payload"])) is not None}
    got = queries.p3_table(spark, MIDDLE).collect()
    assert len(got) == len(table)
    names = {"v", "hasCm", "l", "p", "t", "mode", "prj", "g", "run", "toolVer"}
    for r in got:
        own, left = table[r["report_id"]], json.loads(r["_rescued"] or "{}")
        assert all(own[k] == x for k, x in left.items())
        assert (r["t"] is None) == (own.get("t") is None)
        assert len(left) + sum(r[n] is not None for n in names) == len(own)
    assert sum(r["p"] is not None for r in got) > sum(isinstance(v.get("p"), str) for v in table.values())


def test_payloads_of_any_depth_are_read(spark):
    deep = '{"prj":[{"n":"a","x":' + "[" * 100_000 + "]" * 100_000 + '}],"y":' + '{"a":' * 100_000 + "1.50" + "}" * 100_000 + "}"
    df = spark.createDataFrame([(i, "f", i, deep) for i in range(2)] + [(2, "f", 2, deep[:-1])], "report_id long, feed string, seq_no int, payload string")
    bridge = nested.shred(df)
    assert sorted(rows(bridge.select("report_id", "node"))) == [(0, "prj[0]"), (1, "prj[0]")]
    assert rows(nested.flat_table(bridge, "project").select("name").distinct()) == [("a",)]
    got = drift.ingest(df).collect()
    assert [r["_rescued"]["y"] for r in got] == ['{"a":' * 100_000 + "1.50" + "}" * 100_000] * 2
    assert drift.drift_events(drift.ingest(df)).count() == 0


def test_value_keys_of_spellings():
    equal = lambda a, b: (lambda x, y: x[0] == y[0] or (not (isinstance(a, str) and isinstance(b, str)) and x[1] is not None and x[1] == y[1]))(drift.value_keys(a), drift.value_keys(b))
    assert equal("5", 5) and equal(5.0, 5) and equal("1.50", 1.5) and equal("true", True) and equal({"a": 1, "b": 2}, {"b": 2, "a": 1})
    assert not equal("5", "5.0") and not equal(1, True) and not equal("", 0) and not equal("x", 0) and not equal([1], [2]) and not equal("nan", 0)


def test_empty_feed_table(spark):
    df = spark.createDataFrame([], "report_id long, feed string, seq_no int, payload string")
    assert drift.drift_events(drift.ingest(df)).count() == 0 and nested.shred(df).count() == 0


# ---- 4: dense totals


def test_dense_totals_with_hot_null_and_extreme_keys(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 50 + ["", None, "é", "x" * 5000, *map(str, range(40))]), rng.choice([None, 0, 1, -7, 2**31 - 1]), "c") for _ in range(20_000)]
    want = defaultdict(lambda: [0, 0])
    for k, v, _ in data:
        want[k][0] += 1
        want[k][1] += v or 0
    df = spark.createDataFrame(data, "k string, v int, rows string").repartition(7)
    got = {r["key"]: [r["rows"], r["total"]] for r in dense_totals.dense_key_totals(df, "k", "v", blocks=5, run_rows=700).collect()}
    assert got == dict(want)
    assert dense_totals.dense_key_totals(df.limit(0), "k", "v").count() == 0


def test_heavy_keys_need_more_than_their_share(spark):
    totals = spark.createDataFrame([("a", 7, 0), ("b", 8, 0), (None, 99, 0)], "key string, rows long, total long")
    assert [r["key"] for r in dense_totals.heavy_keys(totals, F.lit(350)).collect()] == ["b"]


def test_scatter_sum_is_exact_for_large_and_negative_values():
    import numpy as np

    codes, values = np.array([0, 1, 0, 1, 0]), np.array([2**62 - 1, -5, 3, -(2**40), -9])
    assert list(dense_totals.scatter_sum(codes, values, 3)) == [2**62 - 7, -5 - 2**40, 0]


# ---- 6: snapshot differences


def brute_changes(folder):
    read = lambda t: pq.read_table(f"{folder}/{t}.parquet").to_pylist()
    snaps = defaultdict(dict)
    for s in read("snapshots"):
        snaps[s["solution_path"]][s["analyzed_at"]] = s["snapshot_id"]
    pairs = [(o[a], o[b]) for o in snaps.values() for a, b in zip(sorted(o), sorted(o)[1:], strict=False)]
    low = lambda x: x.lower() if isinstance(x, str) else x
    diags, projects = defaultdict(dict), defaultdict(dict)
    for d in read("diagnostic_items"):
        diags[d["snapshot_id"]][d["pos"]] = tuple(low(d[c]) for c in ("project", "id", "severity", "message", "file", "line", "col_no"))
    for p in read("project_metrics"):
        projects[p["snapshot_id"]][low(p["project_name"])] = (p["project_row_id"], *(p[c] or 0 for c in ("type_count", "method_count", "total_cc", "total_loc")))
    out = []
    for base, head in pairs:
        b, h = projects[base], projects[head]
        for k in {*b, *h}:
            if k not in b:
                out.append((head, "project", -1, h[k][0], "added"))
            elif k not in h:
                out.append((head, "project", b[k][0], -1, "removed"))
            elif b[k][1:] != h[k][1:]:
                out.append((head, "project", b[k][0], h[k][0], "changed"))
        free = dict(sorted(diags[head].items()))
        left = []
        for pos, d in sorted(diags[base].items()):
            same = next((q for q, x in free.items() if x == d), None)
            if same is None:
                left.append((pos, d))
            else:
                del free[same]
        for pos, d in left:
            near = [(abs(x[5] - d[5]), abs(x[6] - d[6]), x[5], x[6], q) for q, x in free.items() if x[:5] == d[:5]]
            if near:
                q = min(near)[4]
                del free[q]
                out.append((head, "diagnostic", pos, q, "changed"))
            else:
                out.append((head, "diagnostic", pos, -1, "removed"))
        out.extend((head, "diagnostic", -1, q, "added") for q in free)
    return Counter(out)


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_p6_found_equals_brute_force(spark, folder):
    got, want = Counter(rows(queries.p6_found(spark, folder))), brute_changes(folder)
    assert got == want and {x[4] for x in want} == {"added", "removed", "changed"}


def test_nearest_pairs_equal_brute_force_with_ties():
    rng = random.Random(3)
    for _ in range(300):
        side = lambda n: [(i, rng.randint(1, 9), rng.randint(1, 4)) for i in rng.sample(range(99), n)]
        base, head = side(rng.randint(0, 12)), side(rng.randint(0, 12))
        free, want = list(head), []
        for pos, line, col in sorted(base):
            if free:
                best = min(free, key=lambda h: (abs(h[1] - line), abs(h[2] - col), h[1], h[2], h[0]))
                free.remove(best)
                want.append((pos, best[0]))
            else:
                want.append((pos, -1))
        want += [(-1, h[0]) for h in free]
        assert sorted(snapshot_diff.pair_nearest(base, head)) == sorted(want)


def test_nearest_example_of_the_survey():
    base, head = [(0, 10, 1), (1, 50, 1), (2, 51, 1)], [(0, 12, 1), (1, 49, 1), (2, 200, 1), (3, 52, 1)]
    assert snapshot_diff.pair_nearest(base, head) == [(0, 0), (1, 1), (2, 3), (-1, 2)]


def test_diagnostics_with_nulls_repeats_and_a_hot_finding(spark):
    items = []
    for pos in range(3000):  # one finding, equal in all fields, fewer times in the head
        items.append(("a", pos, "P", "X", 1, "m", None, None, None, "clash"))
        if pos < 2990:
            items.append(("b", pos, "p", "x", 1, "M", None, None, None, "clash"))
    items += [("a", 5000, "P", "Y", 1, "m", "f", 1, None, "c"), ("b", 5000, "P", "Y", 1, "m", "f", 0, 0, "c"), ("b", 5000, "P", "Y", 1, "m", "f", 0, 0, "c"), (None, 1, "P", "Y", 1, "m", "f", 0, 0, "c")]
    names = "snapshot_id string, pos long, project string, id string, severity int, message string, file string, line int, col_no int, pair string"
    roles = spark.createDataFrame([("a", "b", -1), ("b", "b", 1)], "snapshot_id string, pair string, sign int")
    got = Counter((*r[:4], tuple(r[4])) for r in snapshot_diff.diagnostic_changes(spark.createDataFrame(items, names), roles).collect())
    assert got == Counter([("b", p, -1, "removed", ()) for p in range(2990, 3000)] + [("b", 5000, 5000, "changed", ("col_no", "line"))])
    assert snapshot_diff.diagnostic_changes(spark.createDataFrame([], names), roles).count() == 0


def test_slots_are_settled_by_nonzero_sums():
    assert snapshot_diff.settle_slot(None, (1, 2)) == ("added", []) and snapshot_diff.settle_slot((1, 2), None) == ("removed", [])
    assert snapshot_diff.settle_slot((1, 2), (1, 3)) == ("changed", ["col_no"]) and snapshot_diff.settle_slot((1, 2), (2, 1)) == ("changed", ["col_no", "line"])
    assert snapshot_diff.settle_slot((None, 2), (0, 2)) == ("changed", ["line"])


def test_the_latest_delivery_of_a_key_counts(spark):
    data = [(1, 1, "old", 5), (1, 2, "new", 4), (2, 1, "a", 1), (2, 1, "a", 1), (3, None, "z", 1), (None, 1, "n", 1), (None, 1, "n", 1)]
    df = spark.createDataFrame(data, "k int, at int, v string, w int")
    got = sorted(rows(distinct_by(df, "k", "at")), key=str)
    assert got == sorted([(1, "new", 4), (2, "a", 1), (3, "z", 1), (None, "n", 1), (None, "n", 1)], key=str)
    assert distinct_by(df, ["k", "v"]).count() == 6 and distinct_by(df.limit(0), "k", "at").columns == ["k", "v", "w"]
    one = {r for _ in range(3) for r in rows(distinct_by(df.repartition(5), "k")) if r[0] == 1}
    assert len(one) == 1


def test_snapshot_without_any_row_removes_everything(spark):
    snaps = spark.createDataFrame([("s1", "x", "2025-01-01"), ("s2", "x", "2025-03-09"), ("s2", "x", "2025-03-09"), ("s3", "x", "2025-03-10"), ("n", None, "2025-01-01")], "snapshot_id string, solution_path string, t string")
    snaps = snaps.withColumn("analyzed_at", F.col("t").cast("timestamp_ntz")).withColumn("at", F.lit(1))
    pairs = consecutive_snapshots(snaps)
    assert sorted(rows(pairs)) == [("s2", "s1"), ("s3", "s2")]
    kinds = "snapshot_id string, project_name string, project_row_id long, type_count int, method_count int, total_cc int, total_loc int"
    projects = spark.createDataFrame([("s1", "A", 1, 0, None, 1, 1), ("s1", None, 2, 1, 1, 1, 1), ("s3", "a", 3, None, 0, 1, 1)], kinds)
    got = Counter(tuple(r)[:5] for r in snapshot_diff.project_changes(projects, snapshot_roles(pairs)).collect())
    assert got == Counter([("s2", "a", 1, -1, "removed"), ("s2", None, 2, -1, "removed"), ("s3", "a", -1, 3, "added")])


# ---- blocked windows


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(5)
    data = [(g, o, str(o)) for g in ("a", "b", None) for o in rng.sample(range(-300, 300), 200)]
    df = spark.createDataFrame(data, T.StructType().add("g", "string").add("o", "long").add("v", "string"))
    want_prev, want_next, want_rank = {}, {}, {}
    for g in ("a", "b", None):
        order = sorted(o for x, o, _ in data if x == g)
        for i, o in enumerate(order):
            want_prev[g, o] = str(order[i - 1]) if i else None
            want_next[g, o] = str(order[i + 1]) if i + 1 < len(order) else None
            want_rank[g, o] = i + 1
    get = lambda x, c: {(r["g"], r["o"]): (r[c]["v"] if r[c] else None) for r in x.collect()}
    block = blocked.int_block("o", 16)
    assert get(blocked.blocked_neighbours(df, ["g"], "o", ["v"], block), "prev") == want_prev
    assert get(blocked.blocked_neighbours(df, ["g"], "o", ["v"], block, forward=True), "next") == want_next
    assert {(r["g"], r["o"]): r["rank_no"] for r in blocked.blocked_rank(df, ["g"], "o", block).collect()} == want_rank


def test_strict_reader():
    assert read_object(' {"a":1} ') == {"a": 1} and read_object('{"a":1,"a":2}') == {"a": 2}
    assert read_object("﻿{}") is None and read_object('{"a":Infinity}') is None


def test_numbers_beyond_a_double_and_of_very_many_digits(spark):
    long = "7" * 5000
    texts = [f'{{"a": 1e400, "b": {long}, "v": 1e400, "prj": [{{"n": "P", "x": 1e400, "y": {long}}}]}}', f'{{"a": 10.0e399, "c": {long}, "d": -1e-400, "f": 1e{long}}}', f'{{"a": 1, "b": {long}, "x": NaN}}', f'{{"b": {long}']
    assert [read_object(t) is None for t in texts] == [False, False, True, True]
    first, second = read_object(texts[0]), read_object(texts[1])
    assert drift.json_type(first["a"]) == "decimal" and drift.json_type(first["b"]) == "integer"
    assert drift.value_keys(first["a"]) == drift.value_keys(second["a"]) == ("n1e400", "n1e400") == drift.value_keys("1e400")[1:] * 2
    assert drift.value_keys(first["b"]) == drift.value_keys(second["c"]) and drift.value_keys(second["d"]) == ("n-1e-400",) * 2
    assert drift.value_keys(second["f"]) == (f"n1e{long}",) * 2
    assert nested.canonical(first["prj"]) == f'[{{"n":"P","x":1e400,"y":{long}}}]'
    df = spark.createDataFrame([("f", i, i, t) for i, t in enumerate(texts)], "feed string, seq_no long, report_id long, payload string")
    got = {r["seq_no"]: r["_rescued"] for r in drift.ingest(df).collect()}
    assert set(got) == {0, 1} and got[0]["v"] == "1e400" and got[0]["b"] == long
    events = {(r["seq_no"], r["field_name"], r["drift_kind"], r["old_field_name"]) for r in drift.drift_events(drift.ingest(df)).collect()}
    assert {(1, "c", "renamed", "b"), (1, "d", "added", ""), (1, "v", "removed", "")} <= events and not any(e[1] == "a" for e in events)
    assert [(r["report_id"], r["node"]) for r in nested.shred(df).collect()] == [(0, "prj[0]")]
