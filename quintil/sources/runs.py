"""Run archive: append-only tables keyed by run, and run documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_SCHEMA = """run_id string, experiment_id string, mode string, rows_used long, feature_count long,
run_dir string, canonical_run_dir string,
feature_view struct<name: string, drop_columns: array<string>, permuted_columns: array<string>>,
fixed_effects_used array<struct<fe_name: string, source_columns: array<string>, generated_column: string,
  n_levels: int, max_levels: int, drop_first: boolean>>"""

MANIFEST, CARD = "run_manifest.json", "experiment_card.json"


def scan_run_docs(spark: SparkSession, run_dirs: Sequence[str], name: str = MANIFEST, required: bool = True) -> DataFrame:
    """One row per run document with the directory it came from.

    A file that does not hold a JSON object fails the job.
    """
    empty = spark.createDataFrame([], DOCUMENT_SCHEMA + ", directory string")
    frames = []
    for directory in run_dirs:
        reader = spark.read.schema(DOCUMENT_SCHEMA + ", _bad string").option("multiLine", True)
        try:
            frame = reader.option("columnNameOfCorruptRecord", "_bad").json(f"{directory}/{name}")
        except AnalysisException:
            if required:
                raise FileNotFoundError(f"Run document does not exist: {directory}/{name}") from None
            continue
        message = F.concat(F.lit("Not a JSON object: "), F.lit(f"{directory}/{name}"))
        checked = F.when(F.col("_bad").isNotNull(), F.raise_error(message)).otherwise(F.lit(directory))
        frames.append(frame.withColumn("directory", checked).drop("_bad"))
    out = empty
    for frame in frames:
        out = out.unionByName(frame)
    return out


class RunRegistry:
    """Tables of all runs under one root, each partitioned by run_id.

    Every write replaces the partition of its own run, so concurrent runs do not
    touch each other's files and a retried run does not double its rows.
    """

    TABLES = ("manifest", "metrics", "predictions", "cv_results", "coefficients", "diagnostics", "samples")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def put(self, table: str, run_id: str, df: DataFrame) -> None:
        tagged = df.drop("run_id").withColumn("run_id", F.lit(run_id))
        writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("run_id").parquet(f"{self.root}/{table}")

    def _stored(self, table: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{table}")

    def read(self, table: str, run_ids: Sequence[str] | None = None) -> DataFrame:
        """Rows of some or all archived runs; runs without a manifest are not complete."""
        df = self._stored(table)
        if run_ids is not None:
            df = df.filter(F.col("run_id").isin(*run_ids))
        if table == "manifest":
            return df
        return df.join(self._stored("manifest").select("run_id").distinct(), "run_id", "left_semi")

    def has(self, run_id: str) -> bool:
        try:
            return not self.read("manifest", [run_id]).isEmpty()
        except AnalysisException:
            return False

    def record(self, run_id: str, tables: Mapping[str, DataFrame]) -> None:
        """Archive a run once; its manifest comes last and marks it complete."""
        if self.has(run_id):
            raise ValueError(f"Run {run_id} is already archived.")
        for name, df in sorted(tables.items(), key=lambda item: item[0] == "manifest"):
            self.put(name, run_id, df)
