"""Deeply nested records as flat tables, by Merkle identities of their subtrees.

Objects are canonicalised and hashed bottom-up: an object's identity covers its own fields and the
identities and positions of the objects it holds. Equal subtrees so have equal identities wherever
they occur. ``shred`` gives two kinds of rows in one pass over the payloads: bridge rows, one per
occurrence, that link a node to the node that holds it with its position, and bodies, the own fields
of an object, sent once per object and batch and then stored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.strict_json import canonical, read_object
from plumbline.session import broadcast_if_small, durable, ship


@dataclass(frozen=True)
class Shape:
    """Which fields of which level hold objects of which level."""

    top: str
    children: dict[str, dict[str, str]]


#: Fixed names of the compact report format.
COMPACT = Shape(
    "report",
    {
        "report": {"prj": "project"},
        "project": {"ns": "namespace", "types": "type"},
        "namespace": {"types": "type"},
        "type": {"m": "method"},
        "method": {},
    },
)

#: Levels that the engine's JSON functions read; an own field nested deeper stands in the body as a string of its JSON text.
_ENGINE_DEPTH = 900


def _deeper(value: list | dict, most: int) -> bool:
    level: list = [value]
    for _ in range(most):
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (list, dict))]
        if not level:
            return False
    return True


BRIDGE = "report_id bigint, level string, node string, parent_node string, field string, ordinal int, object_hash string, parent_hash string, body string"


class _Shredder:
    def __init__(self, shape: Shape):
        self.shape = shape
        self.rows: list[tuple] = []

    def identity(self, level: str, value: dict, path: str, report: int | None) -> tuple[str, str]:
        """Hash and own fields of one object; its descendants' rows are appended on the way up."""
        kinds = self.shape.children[level]
        own: dict[str, object] = {}
        held: list[tuple[str, str, str, int, str, str]] = []
        for field, item in value.items():
            kind = kinds.get(field)
            if kind is None or not isinstance(item, (list, dict)):
                own[field] = item
                continue
            elements = item if isinstance(item, list) else [item]
            rest = {}
            for position, element in enumerate(elements):
                if isinstance(element, dict):
                    at = f"{path}.{field}[{position}]" if path else f"{field}[{position}]"
                    digest, body = self.identity(kind, element, at, report)
                    held.append((kind, at, field, position, digest, body))
                elif element is not None:
                    rest[str(position)] = element
            own[field] = {"length": len(elements), "array": isinstance(item, list)} | ({"rest": rest} if rest else {})
        body = canonical(own)
        if body.count("[") + body.count("{") > _ENGINE_DEPTH:
            body = canonical({k: canonical(v) if isinstance(v, (list, dict)) and _deeper(v, _ENGINE_DEPTH) else v for k, v in own.items()})
        links = "".join(f"\n{field}[{position}]{digest}" for _, _, field, position, digest, _ in sorted(held, key=lambda h: (h[2], h[3])))
        mine = blake2b(f"{level}\n{body}{links}".encode(), digest_size=16).hexdigest()
        self.rows.extend((report, kind, at, path, field, position, digest, mine, child) for kind, at, field, position, digest, child in held)
        return mine, body


def shred_one(report: int | None, payload: str | None, shape: Shape = COMPACT) -> list[tuple]:
    """Bridge rows of one payload; none unless it is one complete JSON object."""
    value = read_object(payload)
    if value is None:
        return []
    shredder = _Shredder(shape)
    shredder.identity(shape.top, value, "", report)
    return shredder.rows


def _shred(shape: Shape):
    names = [c.split()[0] for c in BRIDGE.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            seen: set[str] = set()
            columns = [list(c) for c in zip(*rows, strict=True)]
            for i, digest in enumerate(columns[6]):
                if digest in seen:
                    columns[8][i] = None
                else:
                    seen.add(digest)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        rows: list[tuple] = []
        for batch in batches:
            for report, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.extend(shred_one(report, payload.as_py(), shape))
                if len(rows) >= 20_000:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    return run


def shred(df: DataFrame, record_id: str = "report_id", payload: str = "payload", shape: Shape = COMPACT) -> DataFrame:
    """Bridge rows of all payloads: one per object at a level below the top.

    ``node`` is the path with positions from 0 in the array, ``parent_node`` that of the holder (the
    empty string below the top), ``object_hash`` the Merkle identity, ``body`` the own fields as
    canonical JSON at an object's first occurrence in a batch and null at the others. Null elements keep
    their position; an object in place of an array is its only element. Values of other types in place
    of a child stay in the holder's body, so nothing is lost. Unreadable payloads give no rows.
    """
    ship(df.sparkSession)
    return df.select(F.col(record_id).cast("bigint").alias("report_id"), F.col(payload).alias("payload")).mapInArrow(_shred(shape), BRIDGE)


def object_store(bridge: DataFrame) -> DataFrame:
    """Each distinct object once: ``object_hash, level, body, occurrences``."""
    return bridge.groupBy("object_hash", "level").agg(F.max("body").alias("body"), F.count(F.lit(1)).alias("occurrences"))


#: Occurrences from which an object is spread over salts, and their number. There are at most rows / HOT such objects.
HOT, SALTS = 100_000, 64

#: Fixed short names of the compact report format with the names and types of the flat tables.
COLUMNS = {
    "project": {"n": ("name", "string"), "tc": ("type_count", "int"), "mc": ("method_count", "int"), "cc": ("total_cc", "int"), "loc": ("total_loc", "int"), "dit": ("max_dit", "int"), "mi": ("avg_mi", "double"), "id": ("internal_deps", "int"), "idx": ("internal_dependents", "int"), "dr": ("dependency_ratio", "double"), "ed": ("external_deps", "int"), "edb": ("external_bcl", "int"), "edp": ("external_packages", "int"), "err": ("errors", "int"), "warn": ("warnings", "int")},
    "namespace": {"n": ("name", "string"), "tc": ("type_count", "int"), "mc": ("method_count", "int"), "cc": ("total_cc", "int"), "loc": ("total_loc", "int"), "dit": ("max_dit", "int"), "mi": ("avg_mi", "double")},
    "type": {"n": ("name", "string"), "dit": ("depth_of_inheritance", "int"), "cc": ("total_cc", "int"), "loc": ("total_loc", "int"), "mi": ("avg_mi", "double")},
    "method": {"n": ("name", "string"), "cc": ("cyclomatic_complexity", "int"), "loc": ("lines_of_executable_code", "int"), "hv": ("halstead_volume", "double"), "mi": ("maintainability_index", "double"), "sl": ("start_line", "int"), "el": ("end_line", "int")},
}


def flat_table(bridge: DataFrame, level: str) -> DataFrame:
    """The rows of one level with their own fields as typed columns and the link to their parent.

    ``bridge`` is read twice (occurrences and bodies); cut its lineage first. Fields are read from an
    object's stored body, once per distinct object; a value that does not fit its type is null. An object that
    may occur in a large part of all rows is spread: its stored row is repeated once per salt, and its
    occurrences take salts in turn, so that no task gets all of them.
    """
    own = bridge.where(F.col("level") == level)
    names = COLUMNS[level]
    store = durable(object_store(own))
    read = F.from_json("body", ", ".join(f"`{short}` string" for short in names)).alias("b")
    fields = [F.expr(f"try_cast(b.`{short}` as {kind})").alias(name) for short, (name, kind) in names.items()]
    last = F.when(F.col("occurrences") > HOT, SALTS - 1).otherwise(0)
    objects = store.select(F.col("object_hash").alias("_hash"), read, F.explode(F.sequence(F.lit(0), last)).alias("_salt")).select("_hash", "_salt", *fields)
    hot = broadcast_if_small(durable(store.where(F.col("occurrences") > HOT).select(F.col("object_hash").alias("_hot"))))
    occurrences = own.select("report_id", "node", "parent_node", "field", "ordinal", "object_hash", "parent_hash").join(hot, F.col("object_hash") == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("report_id", "node"), F.lit(SALTS)).cast("int")).otherwise(0)
    return (
        occurrences.withColumn("_at", salt)
        .join(objects, (F.col("object_hash") == F.col("_hash")) & (F.col("_at") == F.col("_salt")))
        .drop("_hash", "_hot", "_at", "_salt")
    )
