"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, percentiles, tokenizer, topn
from plumbline.session import distinct_by, durable
from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

MEASURES = [
    percentiles.Measure("cyclomatic_complexity", 1, 1_000_000),
    percentiles.Measure("maintainability_index", 0, 100),
    percentiles.Measure("lines_of_executable_code", 0, float(2**31 - 1)),
]
PERCENTS = [25.0, 50.0, 75.0, 90.0, 99.0]


def _method_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Order codes of each method once; the repeated rows of a method_id are equal but for loaded_at."""
    names = [m.name for m in MEASURES]
    rows = table(spark, folder, "method_metrics").select("method_id", "project", F.col("snapshot_id").alias("snapshot"), F.to_date("measured_at").cast("string").alias("day"), *names)
    return percentiles.with_codes(distinct_by(rows, "method_id"), ["project", "snapshot", "day"], MEASURES)


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    groupings = {name: F.col(name) for name in ("project", "snapshot", "day")}
    return percentiles.radix_percentiles(durable(_method_codes(spark, folder)), [m.name for m in MEASURES], groupings, PERCENTS)


def p2_merged_days(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds per project from histograms that were made per day and project and then merged."""
    values = percentiles.unpivot(_method_codes(spark, folder), ["project", "day"], [m.name for m in MEASURES])
    daily = percentiles.digit_histogram(values, ["project", "day"])
    return percentiles.percentiles_from_histogram(percentiles.merge_histograms([daily], ["project"]), ["project"], PERCENTS)


def p2_bounds_hold(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the exact percentiles of projects lie within the bounds that merged daily histograms give."""
    exact = p2_percentiles(spark, folder).where("grouping = 'project'").select(F.col("key").alias("_k"), F.col("measure").alias("_m"), F.col("percent").alias("_p"), F.col("n_values").alias("_n"), "value")
    same = F.col("project").eqNullSafe(F.col("_k")) & (F.col("measure") == F.col("_m")) & (F.col("percent") == F.col("_p"))
    holds = F.col("value").between(F.col("low"), F.col("high")) & (F.col("n_values") == F.col("_n"))
    return p2_merged_days(spark, folder).join(exact, same, "full_outer").select("project", "measure", "percent", F.coalesce(holds, F.lit(False)).alias("holds"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    methods = table(spark, folder, "method_metrics").where("cyclomatic_complexity between 1 and 1000000")
    return topn.top_n_per_group(methods, "project", "method_id", [-F.col("cyclomatic_complexity"), F.col("full_name")], 5, ["int", "string"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, folder, "documents"), ["doc_id"])


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the number of ids, of pieces by their offsets, and the decoded length."""
    ids = tokenizer.encode_texts(table(spark, folder, "documents"), ["doc_id", "text"], offsets=True)
    kept = ids.select("doc_id", F.struct("text", "offsets").alias("was"), "ids")
    back = tokenizer.decode_ids(kept, ["doc_id", "was"])
    same = F.col("text") == F.coalesce("was.text", F.lit(""))
    return back.select("doc_id", same.alias("same_text"), F.length("text").cast("bigint").alias("n_chars"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[mixing.Source]]:
    targets = table(spark, folder, "mix_targets")
    wanted = targets.select("source").where("source is not null").distinct()
    tokens = tokenizer.encode_texts(table(spark, folder, "documents").join(wanted, "source", "left_semi"), ["doc_id", "source"], count_only=True)
    mixture, sources = mixing.mix(tokens, targets)
    return mixture, targets, sources


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0].where("copies > 0")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.reached_shares(*_mixture(spark, folder))


def p8_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Per target source its documents, and whether the mixture keeps its repeats, its tokens and its share of zero."""
    mixture, targets, sources = _mixture(spark, folder)
    shares = mixing.reached_shares(mixture, targets, sources)
    documents = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return shares.join(documents, "source", "left").select(
        "source",
        F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"),
        (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"),
        (F.col("tokens_used") <= F.col("tokens_wanted") + 0.5).alias("tokens_kept"),
        ((F.col("target_share") > 0) | (F.col("tokens_used") == 0)).alias("zero_kept"),
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.unnamed_languages(langid.language_segments(table(spark, folder, "documents")))


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_segments(table(spark, folder, "documents"))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return langid.document_languages(langid.language_segments(table(spark, folder, "documents"), every=True))


QUERIES: dict[str, Query] = {
    "p2_percentiles": p2_percentiles,
    "p2_merged_days": p2_merged_days,
    "p2_bounds_hold": p2_bounds_hold,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_constraints": p8_constraints,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
    "p9_documents": p9_documents,
}

_VALUES = """
    m AS (SELECT DISTINCT ON (method_id) method_id, project, snapshot_id, CAST(measured_at AS DATE) AS day,
                 CAST(cyclomatic_complexity AS DOUBLE) AS a, maintainability_index AS b, CAST(lines_of_executable_code AS DOUBLE) AS c FROM method_metrics),
    v AS (SELECT project, snapshot_id, day, 'cyclomatic_complexity' AS measure, a AS value FROM m WHERE a BETWEEN 1 AND 1000000
          UNION ALL SELECT project, snapshot_id, day, 'maintainability_index', b FROM m WHERE NOT isnan(b) AND b BETWEEN 0 AND 100
          UNION ALL SELECT project, snapshot_id, day, 'lines_of_executable_code', c FROM m WHERE c >= 0)"""

_PERCENTS = "(VALUES (2500), (5000), (7500), (9000), (9900)) AS p(basis)"

SQL: dict[str, str] = {
    "p2_percentiles": f"""
        WITH {_VALUES},
        g AS (SELECT 'project' AS "grouping", project AS key, measure, value FROM v
              UNION ALL SELECT 'snapshot', snapshot_id, measure, value FROM v
              UNION ALL SELECT 'day', CAST(day AS VARCHAR), measure, value FROM v),
        r AS (SELECT *, row_number() OVER (PARTITION BY "grouping", key, measure ORDER BY value) AS k,
                     count(*) OVER (PARTITION BY "grouping", key, measure) AS n_values FROM g)
        SELECT "grouping", key, measure, basis / 100.0 AS percent, n_values, value FROM r, {_PERCENTS}
        WHERE k = greatest(1, (basis * n_values + 9999) // 10000)""".replace("basis / 100.0 AS percent", "CAST(basis AS DOUBLE) / 100 AS percent"),
    "p2_bounds_hold": f"""
        WITH {_VALUES}, g AS (SELECT project, measure FROM v GROUP BY 1, 2)
        SELECT project, measure, CAST(basis AS DOUBLE) / 100 AS percent, true AS holds FROM g, {_PERCENTS}""",
    "p8_constraints": """
        SELECT t.source, count(d.doc_id) AS documents, true AS repeats_kept, true AS tokens_kept, true AS zero_kept
        FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL) t LEFT JOIN documents d ON d.source = t.source GROUP BY 1""",
    "p5_found": """
        WITH m AS (SELECT DISTINCT project, method_id, cyclomatic_complexity, full_name FROM method_metrics
                   WHERE project IS NOT NULL AND cyclomatic_complexity BETWEEN 1 AND 1000000)
        SELECT project, CAST(rank_no AS INTEGER) AS rank_no, method_id FROM (
            SELECT *, row_number() OVER (PARTITION BY project ORDER BY cyclomatic_complexity DESC, full_name, method_id) AS rank_no FROM m)
        WHERE rank_no <= 5""",
    "p7_round_trip": "SELECT doc_id, true AS same_text, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM documents",
}
