"""Scalar formulas and classifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity labels by rank (fixed values).
SEVERITIES = ["hidden", "info", "warning", "error"]
#: Dependency kinds by code (fixed values).
DEPENDENCY_KINDS = {0: "project", 1: "assembly", 2: "namespace", 3: "type", 4: "method"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_even(x: Column | str, digits: int) -> Column:
    """Half-to-even rounding of the scaled double."""
    scale = F.lit(float(10**digits))
    return F.rint(col(x) * scale) / scale


def halstead_vocabulary(n1, n2) -> Column:
    return col(n1) + col(n2)


def halstead_length(total1, total2) -> Column:
    return col(total1) + col(total2)


def halstead_volume(n1, n2, total1, total2) -> Column:
    """N log2(n), 0 where there are no tokens or a single distinct one."""
    words, length = halstead_vocabulary(n1, n2), halstead_length(total1, total2)
    return F.when((length > 0) & (words > 1), length * F.log2(words)).otherwise(0.0)


def halstead_difficulty(n1, n2, total2) -> Column:
    return F.when(col(n2) > 0, (col(n1) / 2.0) * (col(total2) / F.nullif(col(n2), F.lit(0)))).otherwise(0.0)


def halstead_effort(n1, n2, total1, total2) -> Column:
    return halstead_difficulty(n1, n2, total2) * halstead_volume(n1, n2, total1, total2)


def maintainability_index(volume, complexity, lines) -> Column:
    """0 to 100; 100 where volume or lines are not positive."""
    raw = 171.0 - 5.2 * F.ln(col(volume)) - 0.23 * col(complexity) - 16.2 * F.ln(col(lines))
    return F.when((col(volume) <= 0) | (col(lines) <= 0), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100.0 / 171.0)))


def body_measures(has_body, is_expression, complexity, lines, volume) -> Column:
    """Measures of a method: one without body has fixed ones; an expression body counts one line,
    while its index is computed from the lines that were counted."""
    plain = F.struct(
        col(complexity).alias("complexity"),
        F.when(col(lines) > 0, col(lines)).otherwise(F.when(col(is_expression), 1).otherwise(0)).alias("lines"),
        col(volume).alias("volume"),
        maintainability_index(volume, complexity, lines).alias("maintainability"),
    )
    none = F.struct(F.lit(1).alias("complexity"), F.lit(0).alias("lines"), F.lit(0.0).alias("volume"), F.lit(100.0).alias("maintainability"))
    return F.when(col(has_body), plain).otherwise(none)


def namespace_of(full_name, default: str = "(global)") -> Column:
    """The text before the last dot; ``default`` where there is none or it is the first character."""
    cut = F.length(col(full_name)) - F.length(F.substring_index(col(full_name), ".", -1))
    return F.when(cut > 1, F.substring(col(full_name), F.lit(1), cut - 1)).otherwise(F.lit(default))


def short_name(full_name) -> Column:
    """The name after the last dot, with the parameters that follow it."""
    name = F.substring_index(col(full_name), "(", 1)
    rest = F.substring(col(full_name), F.length(name) + 1, F.length(col(full_name)))
    return F.concat(F.substring_index(name, ".", -1), rest)


def is_bcl(name) -> Column:
    """Whether a dependency belongs to the framework: System itself or a name under System. or Microsoft."""
    n = col(name)
    return (n == "System") | n.startswith("System.") | n.startswith("Microsoft.")


def is_generated_path(path) -> Column:
    """A path with a segment ``obj`` or a suffix of generated code, in any case and with either slash."""
    p = F.lower(F.replace(col(path), F.lit("\\"), F.lit("/")))
    suffix = reduce(lambda a, b: a | b, [p.endswith(s) for s in (".g.cs", ".g.i.cs", ".designer.cs")])
    return F.array_contains(F.split(p, "/"), "obj") | suffix


def keeps_diagnostic(severity, code, path, suppressed=None) -> Column:
    """Not suppressed, not in generated code, and either visible or a compiler's own."""
    shown = (col(severity) != 0) | F.upper(col(code)).startswith("CS")
    kept = ~is_generated_path(path) & shown
    return kept if suppressed is None else kept & ~col(suppressed)


def severity_label(severity) -> Column:
    pairs = [x for i, s in enumerate(SEVERITIES) for x in (F.lit(i), F.lit(s))]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(severity)), F.lit("hidden"))


def severity_rank(label) -> Column:
    """The rank of a severity name in any case; unknown names are hidden."""
    pairs = [x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(col(label))), F.lit(0))


def dependency_kind(code) -> Column:
    pairs = [x for i, s in DEPENDENCY_KINDS.items() for x in (F.lit(i), F.lit(s))]
    return F.element_at(F.create_map(*pairs), col(code))


def one_based(position) -> Column:
    return col(position) + 1


def location(path, line) -> Column:
    """``file:line`` of a 0-based line."""
    return F.concat_ws(":", col(path), one_based(line).cast("string"))


def basename(path) -> Column:
    return F.substring_index(F.replace(col(path), F.lit("\\"), F.lit("/")), "/", -1)


def stem(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def short_sha(sha) -> Column:
    return F.when(F.trim(F.coalesce(col(sha), F.lit(""))) == "", "unknown").otherwise(F.substring(col(sha), 1, 7))


def sanitised_branch(name) -> Column:
    """Characters that file names cannot hold become underscores."""
    return F.regexp_replace(col(name), r'[<>:"|?*/\\\x00-\x1f]', "_")


def markdown_escape(text) -> Column:
    return F.replace(col(text), F.lit("|"), F.lit("\\|"))


def script_escape(text) -> Column:
    """Backslash, quote, line ends and tabs as escapes of a script's string literal."""
    out = col(text)
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def signed_delta(value) -> Column:
    """``0``, ``+n`` or ``-n``."""
    return F.when(col(value) > 0, F.concat(F.lit("+"), col(value).cast("string"))).otherwise(col(value).cast("string"))


def signed_delta_decimal(value) -> Column:
    """One decimal with its sign; values that round to nothing are ``0``."""
    text = F.format_string("%.1f", col(value))
    return F.when(F.abs(col(value)) < 0.0001, "0").when(col(value) > 0, F.concat(F.lit("+"), text)).otherwise(text)


def complexity_semantic(delta, base) -> Column:
    """Bad where complexity rises by more than 50 or by more than a tenth of the base."""
    share = F.when(col(base) > 0, col(delta) / F.nullif(col(base), F.lit(0))).otherwise(0.0)
    return F.when((col(delta) > 50) | (share > 0.1), "bad_increase").otherwise("neutral")


def maintainability_semantic(delta) -> Column:
    d = col(delta)
    return F.when(d <= -10, "severe_decrease").when(d <= -5, "moderate_decrease").when(d > 0, "good_increase").otherwise("neutral")


def warnings_semantic(delta) -> Column:
    return F.when(col(delta) > 0, "bad_increase").when(col(delta) < 0, "good_decrease").otherwise("neutral")


#: How a meaning is shown in Markdown (fixed values).
MARKS = {
    "critical_increase": "🚨 **%s**",
    "bad_increase": "⚠️ **%s**",
    "severe_decrease": "🔴 **%s**",
    "moderate_decrease": "⚠️ **%s**",
    "good_decrease": "✅ %s",
    "good_increase": "✅ %s",
    "needs_review": "🔍 **%s**",
}


def decorated(text, semantic) -> Column:
    pairs = [F.lit(x) for kv in MARKS.items() for x in kv]
    shape = F.coalesce(F.element_at(F.create_map(*pairs), col(semantic)), F.lit("%s"))
    return F.when(col(text) == "0", "0").otherwise(F.replace(shape, F.lit("%s"), col(text)))


def solved_added(base, head, solved, added, moved=None) -> Column:
    """Solved and added counts; where nothing is known of them, from the difference of the totals."""
    known = (col(solved) > 0) | (col(added) > 0)
    if moved is not None:
        known = known | (col(moved) > 0)
    delta = col(head) - col(base)
    zero = F.lit(0).cast("bigint")
    derived = F.struct(F.greatest(-delta, zero).cast("bigint").alias("solved"), F.greatest(delta, zero).cast("bigint").alias("added"))
    return F.when(known, F.struct(col(solved).cast("bigint").alias("solved"), col(added).cast("bigint").alias("added"))).otherwise(derived)


def diagnostics_score(errors, warnings) -> Column:
    return F.coalesce(col(errors), F.lit(0)) * 5 + F.coalesce(col(warnings), F.lit(0))


def inverse_maintainability(mi) -> Column:
    """100 minus the index; a missing index or one of 0 counts as 100."""
    return 100.0 - F.coalesce(F.nullif(col(mi), F.lit(0.0)), F.lit(100.0))


#: Light palette of the heat scale (fixed values): green, yellow, red.
HEAT = [(168, 213, 186), (240, 230, 184), (232, 184, 184)]


def heat_colour(ratio) -> Column:
    """``rgb(r, g, b)`` between green at 0, yellow at a half and red at 1."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(ratio)))
    low = r < 0.5
    t = F.when(low, r * 2).otherwise((r - 0.5) * 2)
    part = lambda a, b: F.floor(F.lit(float(a)) + t * F.lit(float(b - a)) + 0.5).cast("string")
    channels = [F.when(low, part(g, y)).otherwise(part(y, d)) for g, y, d in zip(*HEAT, strict=True)]
    return F.concat(F.lit("rgb("), channels[0], F.lit(", "), channels[1], F.lit(", "), channels[2], F.lit(")"))


def metric_bar(value, most: float = 100.0, good: float = 60.0, medium: float = 40.0) -> Column:
    """Width in percent and quality class of a bar."""
    width = F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(value) / most * 100.0))
    return F.struct(width.alias("width"), F.when(col(value) >= good, "mi-good").when(col(value) >= medium, "mi-medium").otherwise("mi-poor").alias("quality"))


def stroke_width(weight) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(4.0), col(weight) / 2.0))


def font_size(radius) -> Column:
    return F.greatest(F.lit(9.0), F.least(F.lit(12.0), col(radius) / 3.0))


def node_measure(name: str, layer: str) -> Column:
    """The column expression of a viewer's measure; project-only ones fall back to the out-weight."""
    project_only = {"diagnostics": diagnostics_score("err", "warn"), "bcl-deps": F.col("edb"), "package-deps": F.col("edp")}
    both = {"coupling": F.col("id"), "external-deps": F.col("ed"), "complexity": F.col("cc"), "loc": F.col("loc"), "maintainability": inverse_maintainability("mi")}
    choice = both.get(name, project_only.get(name) if layer == "project" else None)
    return F.coalesce((F.col("dep_count") if choice is None else choice).cast("double"), F.lit(0.0))
