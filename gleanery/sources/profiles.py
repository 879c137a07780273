"""Profiles, sessions, feedback and reports as tables: schemas, readers, versioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gleanery.operators.stats import latest
from gleanery.sources.sinks import CSV

PROFILE = """name string, description string, media_types array<string>,
  categories array<struct<name:string,description:string,color:string>>, default_category string,
  top_priorities array<string>, positive_criteria map<string,array<string>>, negative_criteria map<string,array<string>>,
  specific_guidance array<string>, philosophy string, thresholds map<string,int>, scoring_rubric map<string,string>,
  dimensions array<struct<name:string,description:string>>, created_at string, updated_at string, version int"""
SESSION = """session_id string, profile_name string, folder_path string, status string, created_at timestamp,
  updated_at timestamp, bursts array<array<string>>, singletons array<string>, total_files long, total_photos long,
  media_types array<string>, comparisons_served int"""
FEEDBACK = "file_path string, correct_category string, reasoning string, submitted_at timestamp"
REPORT = """source string, destination string, classification string, score int, burst_id string, burst_size int,
  burst_index int, rank int, reasoning string, contains_children boolean, is_appropriate boolean,
  is_error_fallback boolean, error_type string, error_message string, retry_count int, content_summary string,
  key_topics string"""


def _json(spark: SparkSession, path: str, schema: str, key: str, lines: bool = False) -> DataFrame:
    """JSON files, one object or list each, or with ``lines`` one object a line, as Spark writes tables; unreadable ones and rows without ``key`` are left out; no file, no row."""
    try:
        rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
        return rows.where(F.col(key).isNotNull())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, PROFILE, "name")


def sessions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    rows = _json(spark, path, SESSION, "session_id", lines)
    return rows.withColumn("total_files", F.coalesce("total_files", "total_photos")).drop("total_photos")


def latest_sessions(saves: DataFrame) -> DataFrame:
    """The last save of every session."""
    return latest(saves, "session_id", "updated_at")


def feedback(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, FEEDBACK, "file_path", lines)


def listed(profiles: DataFrame) -> DataFrame:
    """(name, categories, default_category, described): each profile with the names of its categories and a text on it
    to be read."""
    names = F.transform("categories", lambda c: c["name"])
    limits = F.array_join(F.transform(F.array_sort(F.map_entries("thresholds")), lambda e: F.concat(e["key"], F.lit(" from "), e["value"].cast("string"))), ", ")
    text = F.concat(
        F.col("name"), F.lit(": "), F.array_join(names, ", "), F.lit("; else "), F.col("default_category"),
        F.when(F.length(limits) > 0, F.concat(F.lit("; "), limits)).otherwise(""),
    )
    return profiles.select("name", names.alias("categories"), "default_category", text.alias("described"))


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).options(**CSV).option("multiLine", True).csv(path)


def write_report(results: DataFrame, path: str) -> None:
    """The 17-column report; list columns are joined by commas, missing columns are empty."""
    have = set(results.columns)

    def column(name: str, kind: str):
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        return (F.concat_ws(",", name) if name == "key_topics" else F.col(name).cast(kind)).alias(name)

    columns = [part.strip().split() for part in REPORT.replace("\n", " ").split(",")]
    results.select(*[column(n, k) for n, k in columns]).write.mode("overwrite").options(**CSV).csv(path)


def newest_report(spark: SparkSession, folder: str, pattern: str = "classification_report_*.csv") -> str | None:
    """The report written last, a file or a folder of parts; of several at one time the last by name. None where there is
    none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    rows = [(f.getModificationTime(), f.getPath().toString()) for f in found or []]
    return max(rows)[1] if rows else None


def current(versions: DataFrame, key: str = "name", version: str = "version") -> DataFrame:
    """The newest version of every profile in an append-only table."""
    return latest(versions, key, version)


def revised(row: dict, changes: dict) -> dict:
    """A profile with the known, non-null changes and the next version; nothing is changed in place."""
    known = {part.strip().split()[0] for part in PROFILE.replace("\n", " ").split(",") if part.strip()} - {"name", "version", "created_at"}
    return {**row, **{k: v for k, v in changes.items() if k in known and v is not None}, "version": (row.get("version") or 1) + 1}


def write_routed(results: DataFrame, path: str) -> None:
    """Results as a table with one folder per destination, written without gathering a destination in one task."""
    results.write.mode("overwrite").partitionBy("destination").parquet(path)
