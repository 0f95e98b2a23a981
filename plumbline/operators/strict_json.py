"""Strict reading and canonical writing of JSON texts, whatever their depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal
from json.decoder import scanstring
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship


def _no_constant(name: str) -> None:
    raise ValueError(name)


_NUMBER = re.compile(r"(-?)(0|[1-9]\d*)(?:\.(\d+))?(?:[eE]([+-]?\d+))?", re.ASCII)
#: Digits up to which Python reads an integer at its default setting, with some room.
_DIGITS = 4_000


def spelled_number(text: str) -> str | None:
    """One spelling per number, digits and power of ten, or None; never expands an exponent."""
    m = _NUMBER.fullmatch(text)
    if m is None:
        return None
    sign, whole, fraction, power = m[1], m[2], m[3] or "", m[4] or "0"
    digits = (whole + fraction).lstrip("0")
    short = digits.rstrip("0")
    return f"n{sign}{short}e{_shifted(power, len(digits) - len(short) - len(fraction))}" if short else "n0"


def _shifted(power: str, by: int) -> str:
    if len(power) <= _DIGITS:
        return str(int(power) + by)
    context = Context(prec=len(power) + 20, Emax=MAX_EMAX, Emin=MIN_EMIN)
    return format(context.add(Decimal(power), by), "f")


class Number:
    """A number that neither an integer of Python's usual length nor a double can hold, by its spelling."""

    def __init__(self, text: str, kind: str):
        self.text, self.kind = text, kind


def _decimal(text: str) -> float | Number:
    """A double where it is worth exactly what is spelled; a double of up to 15 digits always is."""
    value = float(text)
    if len(text) <= 16 and "e" not in text and "E" not in text:
        return value
    spelled = spelled_number(text)
    return value if value - value == 0 and spelled_number(repr(value)) == spelled else Number(spelled[1:], "decimal")


def _integer(text: str) -> int | Number:
    return int(text) if len(text) <= _DIGITS else Number(text, "integer")


_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_float=_decimal)
#: Slower, for texts with an integer that the first one refuses.
_long_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_float=_decimal, parse_int=_integer)

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(-?(?:0|[1-9]\d*)((?:\.\d+)?(?:[eE][+-]?\d+)?))|true|false|null", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _key(text: str, at: int) -> tuple[str, int]:
    """The key at ``at`` or after the space there, and the place behind its colon."""
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != '"':
        raise ValueError(at)
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(at)
    return key, at + 1


def _deep_value(text: str, at: int) -> tuple[object, int]:
    """The value at ``at`` and the place behind it, read with a stack of its own instead of the interpreter's."""
    open_ones: list[tuple[dict | list, str | None]] = []
    while True:
        at = _SPACE.match(text, at).end()
        sign = text[at : at + 1]
        if sign in ("{", "["):
            held: dict | list = {} if sign == "{" else []
            after = _SPACE.match(text, at + 1).end()
            if text[after : after + 1] == ("}" if sign == "{" else "]"):
                value, at = held, after + 1
            else:
                key, at = _key(text, after) if sign == "{" else (None, after)
                open_ones.append((held, key))
                continue
        elif sign == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _ATOM.match(text, at)
            if m is None:
                raise ValueError(at)
            at = m.end()
            value = _WORDS[m[0]] if m[1] is None else _decimal(m[0]) if m[2] else _integer(m[0])
        while True:  # the value is complete: it goes to what holds it, which may be complete too
            if not open_ones:
                return value, at
            held, key = open_ones[-1]
            if key is None:
                held.append(value)
            else:
                held[key] = value
            at = _SPACE.match(text, at).end()
            sign = text[at : at + 1]
            if sign == ",":
                if key is not None:
                    key, at = _key(text, at + 1)
                    open_ones[-1] = (held, key)
                else:
                    at += 1
                break
            if sign != ("]" if key is None else "}"):
                raise ValueError(at)
            value, at = held, at + 1
            open_ones.pop()


def _whole(text: str) -> object:
    value, at = _deep_value(text, 0)
    if _SPACE.match(text, at).end() != len(text):
        raise ValueError(at)
    return value


def read_value(text: str) -> object:
    """The value that ``text`` is; ValueError where it is none."""
    for read in (_decoder.decode, _long_decoder.decode, _whole):
        try:
            return read(text)
        except json.JSONDecodeError:
            raise
        except (ValueError, RecursionError):
            if read is _whole:
                raise


def read_object(text: str | None) -> dict | None:
    """The object that ``text`` is, or None.

    None for null, empty and blank texts, texts that break off or go on after the object, values
    other than objects, NaN and infinities. White space around the object is allowed; of a repeated
    key the last value counts. A number beyond a double or of very many digits is a ``Number``. Depth
    has no limit.
    """
    if not text:
        return None
    try:
        value = read_value(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def read_fields(text: str | None) -> dict[str, tuple[object, str]] | None:
    """The fields of the object that ``text`` is, each with its value and its own text, or None as ``read_object``."""
    if not text:
        return None
    for scan in (_decoder.scan_once, _long_decoder.scan_once, _deep_value):
        try:
            return _fields(text, scan)
        except (json.JSONDecodeError, StopIteration):
            return None
        except (ValueError, RecursionError):
            continue
    return None


def _fields(text: str, scan) -> dict[str, tuple[object, str]] | None:
    at = _SPACE.match(text).end()
    if text[at : at + 1] != "{":
        return None
    out: dict[str, tuple[object, str]] = {}
    at = _SPACE.match(text, at + 1).end()
    if text[at : at + 1] == "}":
        at += 1
    else:
        while True:
            key, at = _key(text, at)
            begin = _SPACE.match(text, at).end()
            value, stop = scan(text, begin)
            out[key] = (value, text[begin:stop])
            at = _SPACE.match(text, stop).end()
            sign, at = text[at : at + 1], at + 1
            if sign == "}":
                break
            if sign != ",":
                return None
    return out if _SPACE.match(text, at).end() == len(text) else None


def _reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            reason = None
            if text is None or not text.strip(" \t\n\r"):
                reason = "missing"
            elif read_object(text) is None:
                try:
                    read_value(text)
                    reason = "no object"
                except ValueError:
                    reason = "unreadable"
            rows.append(reason)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], [batch.schema.names[0], "reason"])


def unreadable(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, reason`` of each payload that is not one complete JSON object: missing, unreadable, or no object."""
    ship(df.sparkSession)
    narrow = df.select(key, F.col(payload).cast("string").alias("payload"))
    return narrow.mapInArrow(_reasons, f"`{key}` {narrow.schema[key].dataType.simpleString()}, reason string").where("reason is not null")


#: Stands before a ``Number`` while it is written as a string; no text holds it by chance.
_MARK = uuid4().hex
_MARKED = re.compile(f'"{_MARK}([^"]*)"')


def _marked(value: object) -> str:
    if isinstance(value, Number):
        return _MARK + value.text
    raise TypeError(type(value))


_encoder = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=_marked)


def canonical(value: object) -> str:
    """One spelling per value: sorted keys, no layout, ASCII only. Depth has no limit."""
    try:
        text = _encoder.encode(value)
    except RecursionError:
        text = _deep_text(value)
    return _MARKED.sub(r"\1", text) if _MARK in text else text


def _deep_text(value: object) -> str:
    """``canonical`` with a list of what is still to write; a tuple there is finished text."""
    out: list[str] = []
    todo: list[object] = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, list):
            todo.append(("]",))
            for i in range(len(x) - 1, -1, -1):
                todo.extend((x[i], ("," if i else "",)))
            todo.append(("[",))
        elif isinstance(x, dict):
            todo.append(("}",))
            names = sorted(x)
            for i in range(len(names) - 1, -1, -1):
                todo.extend((x[names[i]], (f"{',' if i else ''}{_encoder.encode(names[i])}:",)))
            todo.append(("{",))
        else:
            out.append(_encoder.encode(x))
    return "".join(out)
