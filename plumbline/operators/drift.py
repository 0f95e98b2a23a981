"""Schemas that drift between files: rescue-column ingestion and the report of every change.

``ingest`` enforces a target schema on JSON payloads. A top-level field that the target knows and whose value
is of its column's own type goes into that column; everything else, unknown fields, values of other types and
nulls, is kept in ``_rescued``, each value as its own JSON text. So typed columns and ``_rescued`` together hold
a file whole, and ``drift_events`` derives every change from them. ``learned_names`` takes from these changes which
further names a field goes by, and ``promote`` replays rescued values into typed columns, casting what another
type spells, without reading a payload again.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b, md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.blocked import blocked_neighbours, int_block
from plumbline.operators.strict_json import Number, canonical, read_fields, read_value, spelled_number
from plumbline.session import broadcast_if_small, checkpoint_root, durable, keep_until_release, ship

#: Target schema of compact reports: type by field. ``json`` takes arrays and objects as JSON text, ``millis`` a time
#: in milliseconds, which may also be spelled as seconds with a fraction or as an ISO timestamp.
COMPACT_TARGET = {"v": "bigint", "hasCm": "boolean", "l": "json", "p": "string", "t": "millis", "mode": "string", "prj": "json", "g": "json"}

#: Fields that are approved for promotion beside those of the target.
COMPACT_PROMOTED = {"run": "bigint", "toolVer": "string"}

#: Optional parts of the format whose coming and going is no drift.
IGNORED = ("diag", "gitSha", "gitBranch", "gitRemote", "gitDirty", "toolVer")

_ARROW = {"bigint": pa.int64(), "millis": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "json": pa.string()}
_SQL = {"bigint": "bigint", "millis": "bigint", "double": "double", "boolean": "boolean", "string": "string", "json": "string"}
#: JSON type of what a typed column holds.
_KIND = {"bigint": "integer", "millis": "integer", "double": "decimal", "boolean": "boolean", "string": "string"}
RESCUED = "_rescued map<string,string>"


def json_type(value: object) -> str:
    """integer, decimal, string, boolean, array, object, or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "decimal"
    if isinstance(value, Number):
        return value.kind
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def value_keys(value: object) -> tuple[str, str | None]:
    """Two keys of a value: one of the value with its type, one of the number or boolean it is or spells.

    Values of different types are equal where their second keys are; values of one type where their
    first keys are. Numbers count by what they are worth, so 1 and 1.0 are equal.
    """
    kind = json_type(value)
    if kind in ("array", "object"):
        return "c" + md5(canonical(value).encode()).hexdigest(), None
    if kind == "boolean":
        return f"b{value}".lower(), f"b{value}".lower()
    if kind in ("integer", "decimal"):
        spelled = spelled_number(value.text if isinstance(value, Number) else repr(value))
        return spelled, spelled
    if kind == "null":
        return "null", None
    text = value.strip()
    spelled = f"b{text.lower()}" if text.lower() in ("true", "false") else spelled_number(text) if len(text) <= 64 and text[:1] in "-0123456789" and text else None
    return "s" + (value if len(value) <= 40 else blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()), spelled


def _writable(text: str) -> str | None:
    """The text, or None where it holds half a surrogate pair and so is no UTF-8."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return None
    return text


def fit(value: object, kind: str) -> object:
    """What a column of ``kind`` takes of ``value``, or None where the value is of another type or out of range."""
    if kind == "json":
        return canonical(value) if isinstance(value, (list, dict)) else None
    if json_type(value) != _KIND[kind] or isinstance(value, Number):
        return None
    if kind in ("bigint", "millis"):
        return value if -(2**63) <= value < 2**63 else None
    return _writable(value) if kind == "string" else value


def _parser(target: dict[str, str]):
    names = ["feed", "seq_no", "report_id", *target, "_rescued"]
    types = [pa.string(), pa.int64(), pa.int64(), *[_ARROW[k] for k in target.values()], pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for feed, seq, report, payload in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                fields = read_fields(payload)
                if fields is None:
                    continue
                typed = []
                for name, kind in target.items():
                    got = fit(fields[name][0], kind) if name in fields else None
                    if got is not None:
                        del fields[name]
                    typed.append(got)
                rows.append((feed, seq, report, *typed, [(_writable(n) or canonical(n), raw) for n, (_, raw) in fields.items()]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def ingest(df: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """One row per readable payload: ``feed, seq_no, report_id``, the target's columns, and ``_rescued``.

    A column takes a value of its own type only, so that none changes on the way: integers within 64 bits,
    decimals that a double is worth exactly, booleans, strings, arrays and objects as canonical JSON. Every other
    field, nulls among them, is in ``_rescued``, a map from field name to the JSON text of the value, as it stood in
    the payload. Unreadable, empty and null payloads give no row; repeated deliveries stay (see ``files_of``).
    """
    ship(df.sparkSession)
    target = COMPACT_TARGET if target is None else target
    typed = "".join(f"`{n}` {_SQL[k]}, " for n, k in target.items())
    narrow = df.select("feed", F.col("seq_no").cast("bigint"), F.col("report_id").cast("bigint"), "payload")
    return narrow.mapInArrow(_parser(target), f"feed string, seq_no bigint, report_id bigint, {typed}{RESCUED}")


def rescued_json(rescued: str = "_rescued") -> Column:
    """The rescued fields as one JSON object in the order of their names, every value with its own text; null for none."""
    quoted = lambda n: (lambda text: F.substring(text, F.lit(2), F.length(text) - 2))(F.to_json(F.array(n)))
    fields = F.transform(F.array_sort(F.map_entries(rescued)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    return F.when(F.size(rescued) > 0, F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))


#: Numbers whose worth a decimal(38,10) holds exactly.
_PLAIN = r"-?(0|[1-9][0-9]{0,24})(\.[0-9]{1,10})?"


def cast_json(raw: Column, kind: str) -> Column:
    """The JSON text of a value as ``kind``, also where a value of another type spells it; null where it does not.

    Numbers and booleans may be spelled in strings, integers as decimals without a fraction, booleans as 0, 1, yes and
    no, times as seconds with a fraction or ISO timestamps. A string takes the text of a number or boolean, ``json``
    any value. JSON null is null.
    """
    quoted = raw.startswith('"')
    inner = F.element_at(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), 1)
    if kind == "json":
        return F.when(raw != "null", raw)
    if kind == "string":
        return F.when(quoted, inner).when(~F.substring(raw, 1, 1).isin("{", "[", "n"), raw)
    text = F.when(quoted, F.trim(inner)).otherwise(raw)
    number = F.when(text.rlike(f"^{_PLAIN}$"), text.try_cast("decimal(38,10)"))
    if kind == "boolean":
        said = F.lower(text)
        return F.when(said.isin("true", "yes", "1"), True).when(said.isin("false", "no", "0"), False)
    if kind == "double":
        return text.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("decimal(38,0)").try_cast("bigint"))
    if kind == "bigint":
        return whole
    seconds = F.when(~quoted & text.contains(".") & (F.abs(number) < 100_000_000_000), (number * 1000).cast("decimal(38,0)").try_cast("bigint"))
    stamp = F.when(quoted & text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), F.unix_millis(F.try_to_timestamp(text)))
    return F.coalesce(seconds, stamp, whole)


def promote(rows: DataFrame, field: str, kind: str, names: list[str] | Column | None = None) -> DataFrame:
    """Replay rescued values into the column ``field``, which is added where it is missing.

    A row whose column is null takes the first of the rescued fields ``field`` and ``names`` whose value can be cast
    (see ``cast_json``); that one leaves ``_rescued``, and all others stay in it as they were. ``names`` may be a
    column with an array of each row's own. All JVM-side.
    """
    had = field in rows.columns
    own = F.col(f"`{field}`") if had else F.lit(None).cast(_SQL[kind])
    sought = F.concat(F.array(F.lit(field)), names) if isinstance(names, Column) else F.array(*[F.lit(n) for n in [field, *(names or [])]])
    there = F.filter(sought, lambda n: F.map_contains_key("_rescued", n))
    casts = F.transform(there, lambda n: F.struct(n.alias("name"), cast_json(F.element_at("_rescued", n), kind).alias("value")))
    out = rows.withColumn("_found", F.when(own.isNull(), F.get(F.filter(casts, lambda c: c["value"].isNotNull()), F.lit(0))))
    rest = F.when(F.col("_found").isNull(), F.col("_rescued")).otherwise(F.map_filter("_rescued", lambda k, _: k != F.col("_found.name")))
    filled = out.withColumn("_rescued", rest).withColumn(field, F.coalesce(own, F.col("_found.value")))
    return filled.select(*[f"`{c}`" for c in rows.columns if c != "_rescued"], *([] if had else [f"`{field}`"]), "_rescued")


#: Links between names that the driver settles by itself; more are worked off in rounds over tables.
PAIRS = 10_000

#: Learned names that stand in the plan of a promotion; more are joined.
FEW_NAMES = 256

LEARNED = "name string, field string, votes bigint"


def _settled(links: list[tuple[str, str, int, str | None]]) -> list[tuple[str, str, int]]:
    """``name, field, votes`` learned from links ``name, other, n, field``, in rounds as in ``_learn``."""
    of_name: dict[str, list[tuple[str, int, str | None]]] = defaultdict(list)
    for name, other, n, field in links:
        of_name[name].append((other, n, field))
    of: dict[str, str] = {}
    found = []
    todo = set(of_name)
    while todo:
        new = []
        for name in todo:
            votes: Counter = Counter()
            for other, n, field in of_name[name]:
                if field is not None or other in of:
                    votes[of[other] if field is None else field] += n
            if votes and 2 * (best := votes.most_common(1)[0])[1] > sum(n for _, n, _ in of_name[name]):
                new.append((name, *best))
        of |= {name: field for name, field, _ in new}
        found += new
        todo = {other for name, _, _ in new for other, _, _ in of_name[name]} & of_name.keys() - of.keys()
    return found


def _learn(events: DataFrame, fields: list[str]) -> tuple[DataFrame | None, list[tuple[str, str, int]]]:
    """The names learned in rounds over tables, if any were needed, and those that the driver settled: ``name, field, votes``.

    In each round a name is learned that most of its renames link to one field or to names which earlier rounds
    learned for it. At most ``PAIRS`` links come to the driver, which makes all rounds that are left; while more are
    open, a round is a job. Links and learned names stay in tables, so their number is not bounded.
    """
    spark = events.sparkSession
    ends = [F.struct(F.col(a).alias("name"), F.col(b).alias("other")) for a, b in (("old_field_name", "field_name"), ("field_name", "old_field_name"))]
    renamed = events.where("drift_kind = 'renamed'").select(F.inline(F.array(*ends))).where(~F.col("name").isin(fields))
    linked = renamed.groupBy("name", "other").agg(F.count(F.lit(1)).alias("n"))
    links = durable(linked.withColumn("field", F.when(F.col("other").isin(fields), F.col("other"))))
    known, had, path = None, 0, f"{checkpoint_root(spark)}/plumbline-{uuid.uuid4().hex}"
    while True:
        left = links
        if known is not None:
            small = broadcast_if_small(known)
            to = small.select(F.col("name").alias("other"), F.col("field").alias("_of"))
            left = links.join(small, "name", "left_anti").join(to, "other", "left").select("name", "other", "n", F.coalesce("field", "_of").alias("field"))
        rest = left.limit(PAIRS + 1).collect()
        if len(rest) <= PAIRS:
            return known, _settled([tuple(r) for r in rest])
        votes = left.groupBy("name", "field").agg(F.sum("n").alias("votes"))
        best = F.max_by(F.struct("field", "votes"), F.when(F.col("field").isNotNull(), F.col("votes")))
        new = votes.groupBy("name").agg(F.sum("votes").alias("total"), best.alias("best")).where("2 * best.votes > total").select("name", "best.*")
        if known is None:
            keep_until_release(spark, path)
        new.write.mode("append").option("compression", "zstd").parquet(path)
        known = spark.read.schema(LEARNED).parquet(path)
        if (has := known.count()) == had:
            return known, []
        had = has


def _by_field(learned: list[tuple[str, str, int]], fields: list[str]) -> dict[str, list[str]]:
    names: dict[str, list[str]] = {f: [] for f in fields}
    for name, field, _ in sorted(learned, key=lambda r: (-r[2], r[0])):
        names[field].append(name)
    return names


def learned_names(events: DataFrame, fields: list[str]) -> dict[str, list[str]]:
    """Per field the further names that the found renames give it, the one found in most feeds first.

    A name that is renamed to or from a field, directly or by way of names learned before, is that field's if most of
    the name's renames say so; ties go to no field. All renames count, however many there are. The learned names all
    come to the driver here; ``consistent_table`` leaves them in tables where they are many.
    """
    known, settled = _learn(events, fields)
    return _by_field([*settled, *(map(tuple, known.collect()) if known is not None else [])], fields)


def _with_learned(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """Add ``_learned``: the learned names among a row's rescued fields with their fields, the one found in most feeds first.

    Names are looked up once per distinct set of rescued fields, and these sets are joined with the rows.
    """
    names = F.array_sort(F.map_keys("_rescued"))
    sets = rows.select(names.alias("_names")).where(F.size("_names") > 0).distinct()
    found = sets.select("_names", F.explode("_names").alias("name")).join(broadcast_if_small(learned), "name")
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("least"), "name", "field")))
    held = durable(found.groupBy("_names").agg(order.alias("_learned")))
    return rows.withColumn("_names", names).join(broadcast_if_small(held), "_names", "left").drop("_names")


def consistent_table(rows: DataFrame, events: DataFrame, target: dict[str, str] | None = None, promoted: dict[str, str] | None = None) -> DataFrame:
    """All files under one schema: the target's and the approved fields, filled from every name and type found for them.

    Up to ``FEW_NAMES`` learned names are literals of the plan. Where there are more they are joined, and ``rows`` is
    read twice more; cut its lineage first if it is costly.
    """
    target = COMPACT_TARGET if target is None else target
    wanted = target | (COMPACT_PROMOTED if promoted is None else promoted)
    known, settled = _learn(events, list(wanted))
    if known is None and len(settled) <= FEW_NAMES:
        names = _by_field(settled, list(wanted))
    else:
        table = durable(rows.sparkSession.createDataFrame(settled, LEARNED))
        rows = _with_learned(rows, table if known is None else known.unionByName(table))
        of = lambda field: F.transform(F.filter("_learned", lambda e: e["field"] == field), lambda e: e["name"])
        names = {f: F.coalesce(of(f), F.array().cast("array<string>")) for f in wanted}
    for field, kind in wanted.items():
        rows = promote(rows, field, kind, names[field])
    return rows.drop("_learned")


NOTE = "name: string, kind: string, exact: string, spelled: string"


def _noting(kinds: list[tuple[str, str]]):
    note = pa.struct([("name", pa.string()), ("kind", pa.string()), ("exact", pa.string()), ("spelled", pa.string())])

    def noted(name: str, kind: str, exact: str, spelled: str | None) -> dict:
        return {"name": name, "kind": kind, "exact": exact.encode("utf-8", "replace").decode(), "spelled": spelled}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            notes: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for at, (name, kind) in enumerate(kinds):
                for i, value in enumerate(batch.column(3 + at).to_pylist()):
                    if value is not None and kind == "json":
                        notes[i].append(noted(name, "array" if value[0] == "[" else "object", "c" + value[1:], None))
                    elif value is not None:
                        notes[i].append(noted(name, _KIND[kind], *value_keys(value)))
            for i, fields in enumerate(batch.column(3 + len(kinds)).to_pylist()):
                for name, raw in fields:
                    value = read_value(raw)
                    notes[i].append(noted(name, json_type(value), *value_keys(value)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(notes, pa.list_(note))], ["feed", "seq_no", "report_id", "_fields"])

    return run


def field_notes(rows: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """``feed, seq_no, report_id, _fields`` of ingested rows: name, type and keys of the value of each field that a row holds.

    Arrays and objects of typed columns come to the workers as a hash of their text only.
    """
    ship(rows.sparkSession)
    target = COMPACT_TARGET if target is None else target
    typed = [F.concat(F.substring(n, 1, 1), F.md5(n)).alias(n) if k == "json" else F.col(f"`{n}`") for n, k in target.items()]
    narrow = rows.select("feed", "seq_no", "report_id", *typed, "_rescued")
    return narrow.mapInArrow(_noting(list(target.items())), f"feed string, seq_no bigint, report_id bigint, _fields array<struct<{NOTE}>>")


def files_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per file of a feed: of the readable deliveries of a seq_no, the smallest report_id.

    Rows without feed or seq_no belong to no feed and are left out.
    """
    return (
        rows.where("feed is not null and seq_no is not null")
        .groupBy("feed", "seq_no")
        .agg(F.min_by(F.struct("report_id", *columns), "report_id").alias("f"))
        .select("feed", "seq_no", "f.*")
    )


_MATCH = """
aggregate(
  goners,
  cast(array() as array<struct<old_name: string, new_name: string, old_kind: string, new_kind: string>>),
  (pairs, o) -> concat(pairs, transform(slice(filter(comers,
      n -> not exists(pairs, p -> p.new_name = n.name) and o.exact != 'null' and n.exact != 'null'
           and (n.exact = o.exact or (not (n.kind = 'string' and o.kind = 'string') and n.spelled is not null and o.spelled is not null and n.spelled = o.spelled))), 1, 1),
      n -> struct(o.name as old_name, n.name as new_name, o.kind as old_kind, n.kind as new_kind))))
"""


def drift_events(rows: DataFrame, target: dict[str, str] | None = None, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """``feed, seq_no, field_name, drift_kind, old_field_name`` from the typed and rescued columns of ``ingest``.

    ``added`` at the first file that holds a field unless that is the feed's first, ``removed`` at
    the file after the last that holds it, ``renamed`` in place of a removal and an addition at one file
    whose values are equal and not null, ``retyped`` where the type differs from that of the last
    non-null value. Files are ordered by blocks of seq_no, so that a feed with a third of all files
    is no single task; what is matched within one file is bounded by the fields of two files.
    """
    files = durable(files_of(field_notes(rows, target), ["_fields"]))
    order = files.select("feed", "seq_no")
    nexts = blocked_neighbours(order, ["feed"], "seq_no", ["seq_no"], int_block("seq_no"), forward=True).select("feed", "seq_no", F.col("next.seq_no").alias("after"))
    firsts = order.groupBy("feed").agg(F.min("seq_no").alias("feed_first"))
    fields = files.select("feed", "seq_no", F.inline("_fields")).where(~F.col("name").isin(*ignored))
    note = F.struct("name", "kind", "exact", "spelled")
    ends = durable(
        fields.groupBy("feed", "name").agg(F.min("seq_no").alias("first"), F.max("seq_no").alias("last"), F.min_by(note, "seq_no").alias("came"), F.max_by(note, "seq_no").alias("went"))
    )
    comers = ends.join(firsts, "feed").where("first > feed_first").select("feed", F.col("first").alias("at"), F.col("came").alias("came"), F.lit(None).cast(ends.schema["went"].dataType).alias("went"))
    goners = (
        ends.join(nexts, (ends["feed"] == nexts["feed"]) & (ends["last"] == nexts["seq_no"]))
        .where("after is not null")
        .select(ends["feed"], F.col("after").alias("at"), F.lit(None).cast(ends.schema["came"].dataType).alias("came"), F.col("went"))
    )
    turns = (
        comers.unionByName(goners)
        .groupBy("feed", "at")
        .agg(F.array_sort(F.collect_list("came")).alias("comers"), F.array_sort(F.collect_list("went")).alias("goners"))
        .withColumn("pairs", F.expr(_MATCH))
    )
    none = F.lit("")
    event = lambda name, kind, old: F.struct(name.alias("field_name"), F.lit(kind).alias("drift_kind"), old.alias("old_field_name"))
    said = F.concat(
        F.transform("pairs", lambda p: event(p.new_name, "renamed", p.old_name)),
        F.transform(F.filter("pairs", lambda p: p.new_kind != p.old_kind), lambda p: event(p.new_name, "retyped", none)),
        F.transform(F.filter("comers", lambda c: ~F.exists("pairs", lambda p: p.new_name == c["name"])), lambda c: event(c["name"], "added", none)),
        F.transform(F.filter("goners", lambda g: ~F.exists("pairs", lambda p: p.old_name == g["name"])), lambda g: event(g["name"], "removed", none)),
    )
    moved = turns.select("feed", F.col("at").alias("seq_no"), F.inline(said))
    typed = durable(fields.where("kind != 'null'").select("feed", "name", "seq_no", "kind"))
    retyped = (
        blocked_neighbours(typed, ["feed", "name"], "seq_no", ["kind"], int_block("seq_no"))
        .where("prev.kind != kind")
        .select("feed", "seq_no", F.col("name").alias("field_name"), F.lit("retyped").alias("drift_kind"), none.alias("old_field_name"))
    )
    return moved.unionByName(retyped).select("feed", F.col("seq_no").cast("int").alias("seq_no"), "field_name", "drift_kind", "old_field_name")


__all__ = ["COMPACT_TARGET", "cast_json", "consistent_table", "drift_events", "field_notes", "files_of", "fit", "ingest", "learned_names", "promote", "rescued_json", "value_keys"]
