"""The model tables of the analytics, from the raw tables: each delivered row once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import distinct_by, durable, input_bytes, repeated_keys
from plumbline.sources.tables import table

#: Bytes of a table's files up to which its repeated keys may be broadcast unseen.
SMALL = 32 << 20


@dataclass(frozen=True)
class Model:
    """Lazy views over one folder of tables."""

    spark: SparkSession
    folder: str
    _repeated: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def _once(self, name: str, keys: list[str], columns: list[str]) -> DataFrame:
        """Each row once by its keys, in its latest delivery; the repeated keys of a table are found once per model."""
        rows = table(self.spark, self.folder, name).select(*keys, *columns, "loaded_at")
        if input_bytes(rows) <= SMALL:
            return distinct_by(rows, keys, "loaded_at", small=True)
        if name not in self._repeated:
            self._repeated[name] = durable(repeated_keys(rows, keys))
        return distinct_by(rows, keys, "loaded_at", self._repeated[name])

    def methods(self) -> DataFrame:
        return self._once("method_metrics", ["method_id"], ["snapshot_id", "project", "type_id", "full_name", "file_path", "start_line", "end_line", "cyclomatic_complexity", "lines_of_executable_code", "halstead_volume", "maintainability_index"]).withColumn(
            "maintainability_index", F.when(~F.isnan("maintainability_index"), F.col("maintainability_index"))
        )

    def types(self) -> DataFrame:
        return self._once("type_metrics", ["type_id"], ["snapshot_id", "project", "full_name", "file_path", "depth_of_inheritance"])

    def projects(self) -> DataFrame:
        return self._once("project_metrics", ["project_row_id"], ["snapshot_id", "project_name", "file_path", "type_count", "method_count", "total_cc", "total_loc", "max_dit", "error_count", "warning_count"])

    def diagnostics(self) -> DataFrame:
        return self._once("diagnostic_items", ["snapshot_id", "pos"], ["project", "id", "severity", "message", "file", "line", "col_no", "category", "help_link"])

    def snapshots(self) -> DataFrame:
        return self._once("snapshots", ["snapshot_id"], ["solution_path", "analyzed_at", "tool_version", "analysis_mode", "commit_sha", "branch_name", "remote_url", "is_dirty"])

    def edges(self) -> DataFrame:
        """Dependency rows with both ends; a missing count adds nothing. Repeated rows are real edges."""
        return (
            table(self.spark, self.folder, "dependencies")
            .where("trim(from_entity) != '' and trim(to_entity) != ''")
            .select("snapshot_id", "from_entity", "to_entity", "dep_type", F.coalesce(F.col("reference_count").cast("bigint"), F.lit(0).cast("bigint")).alias("reference_count"))
        )
