"""Token counts of C# text and depths of inheritance."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import metrics as fn
from plumbline.session import durable, ship

#: Operator tokens (fixed values): symbols and keywords.
OPERATOR_SYMBOLS = "+ - * / % ++ -- = += -= *= /= %= &= |= ^= <<= >>= ??= == != < > <= >= && || ! & | ^ ~ << >> ? : ?? . -> => ( ) [ ] , ;".split()
OPERATOR_WORDS = "new typeof sizeof nameof is as await throw return break continue goto if else switch case default while do for foreach try catch finally using lock".split()
#: Keywords that are operands (fixed values).
OPERAND_WORDS = "true false null this base".split()
#: Reserved words of the language (fixed values); those listed in neither group are ignored.
RESERVED = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if "
    "implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static "
    "string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
).split()

#: Comments, strings (raw, verbatim, interpolated, plain), characters, words, numbers, then symbols, longest first.
PATTERN = (
    r'//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|\$*"""[^\x00]*?"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$"(?:[^"\\\n]|\\.)*"|"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'|[A-Za-z_][A-Za-z0-9_]*|[0-9][0-9A-Za-z_]*(?:\.[0-9]+)?|"
    r"<<=|>>=|\?\?=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|==|!=|<=|>=|&&|\|\||<<|>>|\?\?|->|=>|[-+*/%=<>!&|^~?:.()\[\],;]"
)
_TOKEN = re.compile(PATTERN, re.S)
_OPERATORS = frozenset(OPERATOR_SYMBOLS + OPERATOR_WORDS)
_PASSIVE = frozenset(RESERVED) - frozenset(OPERAND_WORDS)


def is_operand(token: str) -> bool:
    """Names, numbers, characters, plain and verbatim strings; raw and interpolated strings and other keywords are ignored."""
    if token.startswith('"""'):
        return False
    return (token[0] in "_\"'" or token[0].isascii() and token[0].isalnum() or token.startswith('@"')) and token not in _PASSIVE and token not in _OPERATORS


def token_counts(code: str | None) -> tuple[int, int, int, int]:
    """Distinct operators and operands by text, then all of each. Null text counts as empty."""
    per = Counter(_TOKEN.findall(code or ""))
    ops = {t: n for t, n in per.items() if t in _OPERATORS}
    named = {t: n for t, n in per.items() if is_operand(t)}
    return len(ops), len(named), sum(ops.values()), sum(named.values())


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = zip(*map(token_counts, batch.column(batch.num_columns - 1).to_pylist()), strict=True) if batch.num_rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int32()) for c in counts]], [*batch.schema.names[:-1], *COUNTS])


COUNTS = ["n1", "n2", "total1", "total2"]


def halstead(df: DataFrame, code: str, keep: list[str]) -> DataFrame:
    """Counts, volume, difficulty and effort of each text; one pass of the lexer's pattern in Arrow batches."""
    ship(df.sparkSession)
    narrow = df.select(*keep, F.col(code).cast("string").alias("_code"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    rows = narrow.mapInArrow(_counting, kept + ", ".join(f"{c} int" for c in COUNTS))
    return rows.select(
        "*",
        fn.halstead_volume("n1", "n2", "total1", "total2").alias("volume"),
        fn.halstead_difficulty("n1", "n2", "total2").alias("difficulty"),
        fn.halstead_effort("n1", "n2", "total1", "total2").alias("effort"),
    )


def depth_of_inheritance(bases: DataFrame, name: str, base: str) -> DataFrame:
    """``name, depth``: the number of bases up to the root, by pointer doubling.

    Each pass joins every open chain with that of the type it has reached, so a chain of n bases takes log2(n) passes, and
    no pass holds more than one row per type. A null, empty or unknown base ends the chain; an unknown base still counts
    as one step. Of several bases given for a name the first in binary order counts. A type whose chain never ends, as
    it leads into a cycle, has a null depth. Rows without a name are left out.
    """
    own = bases.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(F.nullif(F.col(base), F.lit(""))).alias("at"))
    now = durable(own.select("name", "at", F.when(F.col("at").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    names, span = now.count(), 1
    while span <= names and not now.where("at is not null").isEmpty():
        there = now.select(F.col("name").alias("_n"), F.col("at").alias("_at"), F.col("depth").alias("_d"))
        on = now.join(there, F.col("at") == F.col("_n"), "left")
        now = durable(on.select("name", F.col("_at").alias("at"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
        span *= 2
    return now.select("name", F.when(F.col("at").isNull(), F.col("depth")).cast("int").alias("depth"))
