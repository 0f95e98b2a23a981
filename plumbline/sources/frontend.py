"""A lexer-based front end for C# source text: types, methods with measures, and reference edges.

It sees tokens, not symbols: names are resolved against declared types and imported namespaces only by
later joins, and constructs that need a compiler are approximated as the functions say.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.metrics import is_generated_path, namespace_of
from plumbline.operators.tokens import OPERAND_WORDS, OPERATOR_SYMBOLS, OPERATOR_WORDS, PATTERN, RESERVED, is_operand
from plumbline.session import ship

_TOKEN = re.compile(PATTERN + r"|[{}]", re.S)
_OPERATORS = frozenset(OPERATOR_SYMBOLS + OPERATOR_WORDS)
_PASSIVE = frozenset(RESERVED) - frozenset(OPERAND_WORDS)
_KINDS = frozenset(["class", "struct", "interface", "record"])
_BRANCH = frozenset(["if", "while", "for", "foreach", "do", "catch", "&&", "||", "??", "case"])
_BLOCKS = frozenset(["if", "while", "for", "foreach", "do", "switch", "try", "using", "lock"])
_OPEN, _CLOSE = "([{", ")]}"
_MODIFIERS = frozenset("public internal private protected static sealed abstract partial readonly unsafe file ref async extern global".split())
_PREDEFINED = frozenset("void int string bool double float decimal long short byte char object uint ulong ushort sbyte".split())
#: Type of a file's top-level statements.
PROGRAM = "<Program>$"


@dataclass
class Measures:
    """Measures of one body."""

    complexity: int = 1
    lines: int = 0
    operators: list[str] = field(default_factory=list)
    operands: list[str] = field(default_factory=list)

    @property
    def volume(self) -> float:
        words, length = len(set(self.operators)) + len(set(self.operands)), len(self.operators) + len(self.operands)
        return length * math.log2(words) if length and words > 1 else 0.0

    def index(self) -> float:
        if self.volume <= 0 or self.lines <= 0:
            return 100.0
        return max(0.0, min(100.0, (171 - 5.2 * math.log(self.volume) - 0.23 * self.complexity - 16.2 * math.log(self.lines)) * 100 / 171))


def lex(text: str) -> list[tuple[str, int]]:
    """Tokens with their line from 1; comments are left out."""
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if not m[0].startswith(("//", "/*")):
            out.append((m[0], line))
    return out


def _is_conditional(tokens: list[str], at: int) -> bool:
    """A question mark with its colon before the expression ends; one of a nullable type has none."""
    depth = 0
    for t in tokens[at + 1 :]:
        if t in _OPEN:
            depth += 1
        elif t in _CLOSE:
            depth -= 1
            if depth < 0:
                return False
        elif t == ";" or t == "," and depth == 0:
            return False
        elif t == ":" and depth == 0:
            return True
    return False


def measure(tokens: list[str]) -> Measures:
    """Complexity, statements and token lists of a body's tokens, its braces included or not.

    Complexity is 1 and one for each branch, loop, switch label, catch, conditional and short-circuit
    operator. Statements are the simple ones by their semicolon and the compound ones by their keyword.
    """
    m = Measures()
    header, pending_do = 0, 0
    for i, t in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        if t in _OPERATORS:
            m.operators.append(t)
        elif is_operand(t):
            m.operands.append(t)
        if t == "(" and i and tokens[i - 1] in ("for", "foreach"):
            header = 1
        elif header:
            header += (t == "(") - (t == ")")
            if t == ";":
                continue
        closes_do = t == "while" and pending_do and i and tokens[i - 1] == "}"
        if t in _BRANCH and not closes_do or t == "default" and after == ":":
            m.complexity += 1
        elif t == "?" and (after == "." or _is_conditional(tokens, i)):
            m.complexity += 1
        if t == "do":
            pending_do += 1
        if closes_do:
            pending_do -= 1
            continue
        if t in _BLOCKS:
            m.lines += not (t == "using" and after != "(")
            continue
        if t == ";" and i and tokens[i - 1] not in ("{", ";", "}"):
            m.lines += not _ends_do(tokens, i)
    return m


def _ends_do(tokens: list[str], semicolon: int) -> bool:
    """Whether a semicolon ends ``do { } while (...)``."""
    if tokens[semicolon - 1] != ")":
        return False
    depth = 0
    for i in range(semicolon - 1, -1, -1):
        depth += (tokens[i] == ")") - (tokens[i] == "(")
        if depth == 0:
            return i >= 2 and tokens[i - 1] == "while" and tokens[i - 2] == "}" and "do" in tokens[:i]
    return False


def _match(tokens: list[tuple[str, int]], at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the end where there is none."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i][0] in _OPEN) - (tokens[i][0] in _CLOSE)
        if depth == 0:
            return i
    return len(tokens) - 1


def _name_start(words: list[str], at: int) -> int | None:
    """The place of the method name before the parenthesis at ``at``, its type parameters stepped over; None for none."""
    i, depth = at - 1, 0
    while i >= 0 and (depth or set(words[i]) == {">"}):
        depth += words[i].count(">") - words[i].count("<")
        if depth < 0 or words[i] == "operator" or not re.fullmatch(r"\w+|[<>]+|[,.?\[\]]", words[i]):
            return None
        i -= 1
    return i if i >= 0 and re.fullmatch(r"[A-Za-z_]\w*", words[i]) and words[i] not in _PASSIVE else None


def _local_functions(words: list[str]) -> list[tuple[int, int, int, int]]:
    """First token, name, begin of the body and last token of each function declared among statements."""
    out, pairs = [], [(w, 0) for w in words]
    for i, t in enumerate(words):
        name = _name_start(words, i) if t == "(" else None
        before = words[name - 1] if name else ""
        if not (before in _PREDEFINED or before in (">", "]", "?", ")") or re.fullmatch(r"[A-Za-z_]\w*", before) and before not in _PASSIVE and before not in ("await", "new", "return", "async")):
            continue
        close = _match(pairs, i)
        stop = close + 1
        if words[stop : stop + 1] == ["where"]:
            stop = next((k for k in range(stop, len(words)) if words[k] in ("{", ";", "=>")), len(words))
        if stop >= len(words) or words[stop] not in ("{", "=>"):
            continue
        last = _match(pairs, stop) if words[stop] == "{" else next((k for k in range(stop, len(words)) if words[k] == ";"), len(words) - 1)
        first = name - 1
        while first > 0 and words[first - 1] not in (";", "{", "}"):
            first -= 1
        out.append((first, name, stop, last))
    return out


def analyse(path: str, text: str, outer_too: bool = True) -> list[tuple]:
    """Rows ``kind, file_path, name, parent, start_line, end_line, complexity, lines, volume, index, bases, uses`` of one file.

    Kinds are type, method, using and use. Methods of a nested type belong to it and, with ``outer_too``, to each type
    around it as well, so that rollups count them once per type; uses belong to the nested type alone. A use is
    a capitalised name in a type, its bases included, that is no member of something else; ``uses`` counts it.
    Statements outside types are the method Main of a type ``<Program>$``, which is measured with all bodies of the file,
    and their local functions are further methods of it.
    """
    tokens = lex(text)
    words = [t for t, _ in tokens]
    rows: list[tuple] = []
    owners: list[tuple[int, int, str]] = []
    spaces: list[str] = []
    loose: list[tuple[str, int]] = []
    bodies: list[str] = []
    directives = {n for n, x in enumerate(text.split("\n"), 1) if x.lstrip().startswith("#")}

    def statement(i: int, end: int) -> int:
        """The place after the statement at ``i``, or after what is none: an attribute, a modifier, an enum or a delegate."""
        t, line = tokens[i]
        if t in ("}", ";") or line in directives:
            return i + 1
        if t == "[":
            return _match(tokens, i) + 1
        ahead = i
        while ahead < end and words[ahead] in _MODIFIERS:
            ahead += 1
        if ahead < end and words[ahead] in {*_KINDS, "enum", "delegate", "using", "namespace", "alias"}:
            if words[ahead] == "enum":
                return _match(tokens, next((k for k in range(ahead, end) if words[k] == "{"), end - 1)) + 1
            if words[ahead] in ("delegate", "alias"):
                return next((k for k in range(ahead, end) if words[k] == ";"), end) + 1
            if ahead > i:
                return ahead
        k = i
        while k < end and words[k] != ";":
            if words[k] in _OPEN:
                k = _match(tokens, k)
                if words[k] == "}" and words[k + 1 : k + 2] not in ([";"], [","], ["."], [")"], ["while"]):
                    break
            k += 1
        loose.extend(x for x in tokens[i : min(k + 1, end)] if x[1] not in directives)
        return k + 1

    def scan(i: int, end: int, scope: str, in_type: bool, around: tuple[str, ...] = ()) -> None:
        begin = i
        while i < end:
            t, line = tokens[i]
            after = words[i + 1] if i + 1 < end else ""
            stop = next((k for k in range(i, end) if words[k] == ";"), end) if t == "using" else end
            if t == "using" and not in_type and after not in ("(", "var", "") and not (scope == "" and {"(", "new"} & set(words[i + 1 : stop])):
                name = "".join(w for w in words[i + 1 : stop] if w != "static")
                rows.append(("using", path, name.rpartition("=")[2], scope, line, line, None, None, None, None, None, None))
                i = stop + 1
            elif t == "namespace":
                stop = next((k for k in range(i, end) if words[k] in ("{", ";")), end)
                name = "".join(words[i + 1 : stop])
                inner = f"{scope}.{name}" if scope else name
                spaces.append(inner)
                if stop < end and words[stop] == "{":
                    close = _match(tokens, stop)
                    scan(stop + 1, close, inner, False)
                    i = close + 1
                else:
                    scan(stop + 1, end, inner, False)
                    return
            elif t in _KINDS and re.match(r"[A-Za-z_]", after) and not (t == "record" and after in ("class", "struct")):
                stop = next((k for k in range(i, end) if words[k] in ("{", ";")), end)
                full = f"{scope}.{after}" if scope else after
                bases = "".join(words[words.index(":", i, stop) + 1 : stop]) if ":" in words[i:stop] else ""
                close = _match(tokens, stop) if stop < end and words[stop] == "{" else min(stop, end - 1)
                rows.append(("type", path, full, scope, line, tokens[close][1], None, None, None, None, bases, None))
                owners.append((i, close, full))
                if stop < end and words[stop] == "{":
                    scan(stop + 1, close, full, True, (*around, scope) if in_type else ())
                i = close + 1
            elif in_type and t == "[" and (i == begin or words[i - 1] in (";", "{", "}", "]")):
                i = _match(tokens, i) + 1
            elif in_type and t == "(" and (named := _name_start(words, i)) is not None and named >= begin:
                close = _match(tokens, i)
                stop = next((k for k in range(close, end) if words[k] in ("{", ";", "=>", "=")), end)
                if stop >= end or words[stop] == "=":
                    i = close + 1
                    continue
                first = named
                while first > 0 and words[first - 1] not in (";", "{", "}"):
                    first -= 1
                name = f"{scope}.{''.join(words[named:i]).replace(',', ', ')}({_parameters(words[i + 1 : close])})"
                if words[stop] == "{":
                    last = _match(tokens, stop)
                    bodies.extend(words[stop + 1 : last])
                    m = measure(words[stop + 1 : last])
                    shown = (m.complexity, m.lines, m.volume, m.index())
                elif words[stop] == "=>":
                    last = next((k for k in range(stop, end) if words[k] == ";"), end - 1)
                    bodies.extend(words[stop + 1 : last])
                    m = measure(words[stop + 1 : last])
                    shown = (m.complexity, m.lines or 1, m.volume, m.index())
                else:
                    last, shown = stop, (1, 0, 0.0, 100.0)
                holders = (scope, *around[::-1]) if outer_too else (scope,)
                rows.extend(("method", path, name, holder, tokens[first][1], tokens[last][1], *shown, None, None) for holder in holders)
                i = last + 1
            elif in_type and t in ("{", "="):
                i = _match(tokens, i) + 1 if t == "{" else next((k for k in range(i, end) if words[k] == ";"), end) + 1
            else:
                i = i + 1 if in_type or scope else statement(i, end)

    scan(0, len(tokens), "", False)
    if loose:
        said = [t for t, _ in loose]
        m = measure(said + bodies)
        rows.append(("type", path, PROGRAM, "", loose[0][1], loose[-1][1], None, None, None, None, "", None))
        rows.append(("method", path, f"{PROGRAM}.Main(string[])", PROGRAM, loose[0][1], loose[-1][1], m.complexity, m.lines, m.volume, m.index(), None, None))
        for first, name, stop, last in _local_functions(said):
            m = measure(said[stop + 1 : last])
            lines = m.lines or (1 if said[stop] == "=>" else 0)
            rows.append(("method", path, f"{PROGRAM}.{said[name]}()", PROGRAM, loose[first][1], loose[last][1], m.complexity, lines, m.volume, m.index(), None, None))
    if spaces:  # an import before any namespace is one of the file's first namespace
        rows = [(*r[:3], spaces[0], *r[4:]) if r[0] == "using" and not r[3] else r for r in rows]
    counts: Counter = Counter()
    for begin, close, full in owners:
        nested = [(b, c) for b, c, _ in owners if begin < b and c <= close]
        for i in range(begin + 2, close):
            w = words[i]
            if w[0].isupper() and words[i - 1] != "." and not any(b <= i <= c for b, c in nested):
                counts[full, w] += 1
    rows.extend(("use", path, w, full, None, None, None, None, None, None, None, n) for (full, w), n in counts.items())
    return rows


def _parameters(words: list[str]) -> str:
    parts, depth, own = [], 0, []
    for w in [*words, ","]:
        depth += (w in "<([") - (w in ">)]") if len(w) == 1 else 0
        if w == "," and depth == 0:
            if own:
                parts.append("".join(own[:-1]) if len(own) > 1 else own[0])
            own = []
        elif w != "=":
            own.append(w)
    return ", ".join(parts)


SCHEMA = "kind string, file_path string, name string, parent string, start_line int, end_line int, complexity int, lines int, volume double, maintainability double, bases string, uses int"
_TYPES = [pa.string()] * 4 + [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.string(), pa.int32()]


def _analysing(outer_too: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for r in analyse(p, t, outer_too)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    return run


def source_facts(files: DataFrame, path: str = "path", content: str = "content", outer_too: bool = True) -> DataFrame:
    """Types, methods and imports of each source text; generated files and null texts give no rows."""
    ship(files.sparkSession)
    return files.where(~F.coalesce(is_generated_path(path), F.lit(False))).select(F.col(path).cast("string").alias("p"), F.col(content).cast("string").alias("c")).mapInArrow(_analysing(outer_too), SCHEMA)


def reference_edges(facts: DataFrame) -> DataFrame:
    """``from_entity, to_entity, dep_type, reference_count`` of source facts: type edges (3) and namespace edges (2).

    A use refers to a declared type of that short name in the own namespace, in one around it, or in an
    imported one, the first of these that has it; names that none declares give no edge. Type edges
    across namespaces give a namespace edge each, and so does each import of another namespace.
    """
    types = facts.where("kind = 'type'").select(F.col("name").alias("to_entity"), F.substring_index("name", ".", -1).alias("short"), namespace_of("name", "").alias("to_space")).distinct()
    imports = facts.where("kind = 'using'").select(F.col("file_path").alias("_file"), F.col("name").alias("_space")).distinct()
    uses = facts.where("kind = 'use'").select("file_path", F.col("parent").alias("from_entity"), F.col("name").alias("short"), namespace_of("parent", "").alias("from_space"), "uses")
    near = uses.join(types, "short").join(imports, (F.col("file_path") == F.col("_file")) & (F.col("to_space") == F.col("_space")), "left")
    around = (F.col("to_space") == "") | F.col("from_space").startswith(F.concat("to_space", F.lit(".")))
    rank = F.when(F.col("to_space") == F.col("from_space"), 0).when(around, 1).when(F.col("_space").isNotNull(), 2)
    best = (
        near.withColumn("rank", rank)
        .where("rank is not null")
        .groupBy("file_path", "from_entity", "from_space", "short", "uses")
        .agg(F.min(F.struct("rank", -F.length("to_space"), "to_entity", "to_space")).alias("b"))
    )
    found = best.select("from_entity", "from_space", "b.to_entity", "b.to_space", F.col("uses").cast("bigint").alias("reference_count")).where("from_entity != to_entity")
    crossing = found.where("from_space != to_space and to_space != ''")
    opened = facts.where("kind = 'using' and parent != '' and parent != name")
    edge = lambda df, a, b, kind, n: df.select(F.col(a).alias("from_entity"), F.col(b).alias("to_entity"), F.lit(kind).alias("dep_type"), n.alias("reference_count"))
    count = F.col("reference_count")
    every = edge(found, "from_entity", "to_entity", 3, count).unionByName(edge(crossing, "from_space", "to_space", 2, count)).unionByName(edge(opened, "parent", "name", 2, F.lit(1).cast("bigint")))
    return every.groupBy("from_entity", "to_entity", "dep_type").agg(F.sum("reference_count").alias("reference_count"))
