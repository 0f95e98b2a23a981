"""Readers of project files and reports, and the edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from plumbline.functions.metrics import stem
from plumbline.operators.strict_json import canonical, read_object
from plumbline.session import ship

#: Fields of a full report; further fields are ignored, missing ones are null.
REPORT = (
    "solutionPath string, analyzedAt timestamp, toolVersion string, analysisMode int, projects array<struct<name: string, filePath: string, "
    "types: array<struct<fullName: string, filePath: string, depthOfInheritance: int, methods: array<struct<fullName: string, filePath: string, startLine: int, endLine: int, "
    "cyclomaticComplexity: int, linesOfExecutableCode: int, halsteadVolume: double, maintainabilityIndex: double>>>>, "
    "packageReferences: array<string>, projectReferences: array<string>, diagnostics: struct<errorCount: int, warningCount: int, infoCount: int, hiddenCount: int, "
    "diagnostics: array<struct<id: string, message: string, severity: string, file: string, line: int, column: int, category: string, helpLink: string>>>>>, warnings array<string>, "
    "gitInfo struct<commitSha: string, branchName: string, remoteUrl: string, isDirty: boolean>, "
    "couplingAnalysis struct<allDependencies: array<struct<from: string, to: string, type: int, referenceCount: bigint>>>"
)
#: Suffix of the project files that are read.
PROJECT = ".csproj"


def source_files(spark: SparkSession, folder: str, glob: str = "*.cs") -> DataFrame:
    """``path, content`` of all matching files below a folder, in splits by size."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return rows.select("path", F.decode("content", "UTF-8").alias("content"))


def solution_projects(files: DataFrame) -> DataFrame:
    """``path, project_name, project_path`` of the C# projects that solution files (``path, content``) name, each once.

    The suffix says which of the two formats a file has: lines ``Project("...") = "name", "path", ...``, or XML, where the
    name is the project file's. Paths keep their spelling; projects of other languages and folders are left out.
    """
    lower = F.lower("path")
    line = F.lit(r'Project\("[^"]*"\)\s*=\s*"([^"]*)"\s*,\s*"([^"]*)"')
    named = F.arrays_zip(F.regexp_extract_all("content", line, 1).alias("project_name"), F.regexp_extract_all("content", line, 2).alias("project_path"))
    lines = files.where(lower.endswith(".sln")).select("path", F.inline(named))
    paths = files.where(lower.endswith(".slnx")).select("path", F.explode(F.expr("xpath(content, \"//*[local-name()='Project']/@Path\")")).alias("project_path"))
    every = lines.unionByName(paths.select("path", stem("project_path").alias("project_name"), "project_path"))
    return every.where(F.lower("project_path").endswith(PROJECT)).distinct()


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """``path, project_name, project_path`` of a solution's projects, or of the one project that ``path`` names."""
    suffix = path.lower().rpartition(".")[2]
    if suffix in ("sln", "slnx"):
        return solution_projects(source_files(spark, path, "*"))
    if suffix == PROJECT[1:]:
        return spark.createDataFrame([(path,)], "path string").select("path", stem("path").alias("project_name"), F.col("path").alias("project_path"))
    raise ValueError(f"neither a solution nor a project: {path}")


def project_edges(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``path, from_entity, to_entity, dep_type, reference_count``: one edge per project reference of project files."""
    items = resolve_references(project_items(files, "ProjectReference"), projects)
    own = projects.select("path", F.col("project_name").alias("from_entity"))
    return items.join(own, "path").select("path", "from_entity", F.col("project").alias("to_entity"), F.lit(0).alias("dep_type"), F.lit(1).cast("bigint").alias("reference_count"))


def project_items(files: DataFrame, item: str) -> DataFrame:
    """``path, ref``: the Include of each PackageReference or ProjectReference of project files.

    Trimmed, without blanks, once per file without regard to case (the first in binary order stands).
    """
    refs = F.expr(f"xpath(content, \"//*[local-name()='{item}']/@Include\")")
    rows = files.select("path", F.explode(refs).alias("ref")).select("path", F.trim("ref").alias("ref")).where("ref != ''")
    return rows.groupBy("path", F.lower("ref").alias("_k")).agg(F.min("ref").alias("ref")).drop("_k")


def resolve_references(items: DataFrame, projects: DataFrame) -> DataFrame:
    """``path, ref, project``: the project that a reference's path names, else its file name without extension.

    ``projects`` has ``path, project_name``. Paths are compared without regard to case, with either slash and with
    their ``..`` resolved against the referring file.
    """
    slashed = lambda c: F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/")))
    parts = F.concat(F.slice(F.split(slashed("path"), "/"), 1, F.size(F.split("path", r"[\\/]")) - 1), F.split(slashed("ref"), "/"))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))))
    known = projects.groupBy(slashed("path").alias("_at")).agg(F.min("project_name").alias("project_name"))
    joined = items.withColumn("_to", F.array_join(walked, "/")).join(known, F.col("_to") == F.col("_at"), "left")
    return joined.select("path", "ref", F.coalesce("project_name", stem("ref")).alias("project"))


def _spellings(kind: DataType) -> dict:
    """Per field in lower case its name in the schema and the fields below it."""
    if isinstance(kind, ArrayType):
        return _spellings(kind.elementType)
    return {f.name.lower(): (f.name, _spellings(f.dataType)) for f in kind.fields} if isinstance(kind, StructType) else {}


def _respell(value: object, names: dict) -> object:
    if isinstance(value, list):
        return [_respell(x, names) for x in value]
    if isinstance(value, dict) and names:
        return {names.get(k.lower(), (k, {}))[0]: _respell(x, names.get(k.lower(), (k, {}))[1]) for k, x in value.items()}
    return value


def _respelling(names: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [read_object(text) for text in batch.column(1).to_pylist()]
            texts = [None if v is None else canonical(_respell(v, names)) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "report"])

    return run


def parsed_reports(texts: DataFrame) -> DataFrame:
    """Full reports of ``path, content``: the path and the fields of ``REPORT``, by their names in any case.

    A text that is no JSON object has nulls in all fields; ``strict_json.unreadable`` says why.
    """
    ship(texts.sparkSession)
    names = _spellings(StructType.fromDDL(REPORT))
    read = texts.select("path", F.col("content").cast("string")).mapInArrow(_respelling(names), "path string, report string")
    return read.select("path", F.from_json("report", REPORT).alias("r")).select("path", "r.*")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Full reports, one per file, with the file's path."""
    return parsed_reports(source_files(spark, path, "*"))


def report_methods(reports: DataFrame) -> DataFrame:
    """The method rows of full reports with the names of their holders."""
    types = reports.select("path", F.explode("projects").alias("p")).select("path", F.col("p.name").alias("project"), F.explode("p.types").alias("t"))
    return types.select("path", "project", F.col("t.fullName").alias("type_name"), F.inline("t.methods"))


def append_edges(edges: DataFrame, path: str, batch: str | None = None) -> None:
    """Append edges; with the name of a ``batch`` its part of the table is replaced, so a retry doubles nothing."""
    if batch is None:
        edges.write.mode("append").parquet(path)
    else:
        edges.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def reset_edges(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
