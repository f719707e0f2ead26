"""Readers and writers of the engine's tables, with fixed schemas for text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAGRAPH = "struct<number: string, text: string>"
STANDARD = (
    f"as_number string, title string, url string, series string, source_sha256 string, fetched_utc string, notes array<string>, "
    f"sections array<struct<heading: string, level: int, paragraphs: array<{PARAGRAPH}>>>, footnotes array<{PARAGRAPH}>"
)
MANIFEST = (
    "corpus string, version string, downloaded_utc string, source_index string, standard_count int, paragraph_count int, fingerprint string, notes array<string>, "
    "standards array<struct<as_number: string, title: string, series: string, url: string, sha256: string, sections: int, paragraphs: int, footnotes: int>>"
)
CANDIDATE = "question string, answer string, task_type string, paragraph_ids array<string>, footnote_ids array<string>, reasoning_tags array<string>"
DUPLICATE = "left string, right string, unigram double, bigram double, result string, reason string, request_id string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines split at line feeds only; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines, one file a partition; nulls are kept so that every line has every field."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.option("lineSep", "\n").text(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON files, one object each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders below root that hold a manifest, oldest first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where) if s.isDirectory()]
    return sorted(p.getName() for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "manifest.json")))
