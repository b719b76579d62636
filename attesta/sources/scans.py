"""Declared scans: entity tables, raw pages, fixture manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.hashing import content_hash
from attesta.sources.schemas import MANIFEST_DDL, TABLES, entity_schema


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def load_entity(spark: SparkSession, path: str, entity_type: str) -> DataFrame:
    return spark.read.schema(entity_schema(entity_type)).parquet(path)


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages as (url, fetched_at, body, byte_size) from a folder of files about which nothing
    else is known."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("url"), F.col("modificationTime").alias("fetched_at"),
                      F.col("content").alias("body"), F.col("length").alias("byte_size"))


#: Folders that captured pages are dealt to, by a hash of their URL.
CAPTURE_FOLDERS = 64


def capture_pages(pages: DataFrame, root: str, folders: int = CAPTURE_FOLDERS) -> None:
    """Write pages (url, fetched_at, status, content_type, body) as one file per body, and what is
    known of each in lines of a manifest beside them.

    Tasks write the bodies of their own rows through the store that `root` names; a file's name
    is the digest of its URL and capture time, so a task that runs again writes the same files.
    An empty body has a line and no file.
    The manifests are written last: a body without its line is as good as not captured.
    """
    name = F.sha2(F.concat_ws("\n", "url", F.col("fetched_at").cast("string")), 256)
    placed = pages.select(
        F.format_string("%04d", F.pmod(F.xxhash64("url"), F.lit(folders))).alias("folder"),
        F.concat(name, F.lit(".body")).alias("file"), "url",
        F.col("fetched_at").alias("collected_at"), F.col("status").alias("http_status"),
        "content_type", F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body"))
    told = ["folder", "file", "url", "collected_at", "http_status", "content_type"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = root if "://" in root else f"file://{root.removeprefix('file:')}"
        store, base = fs.FileSystem.from_uri(named)
        for batch in batches:
            digests = []
            for folder, file, body in zip(*(batch.column(c).to_pylist()
                                            for c in ("folder", "file", "body"))):
                if body:
                    store.create_dir(f"{base}/folder={folder}", recursive=True)
                    with store.open_output_stream(f"{base}/folder={folder}/{file}") as out:
                        out.write(body)
                digests.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in told), pa.array(digests, pa.string())],
                names=[*told, "sha256"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, "
                     for f in placed.select(*told).schema) + "sha256 string"
    written = placed.mapInArrow(write, schema)
    entry = F.struct("file", "url", "collected_at", "sha256", "content_type", "http_status")
    (written.select("folder", F.array(entry).alias("files"))
     .write.mode("overwrite").json(f"{root}/manifests"))


def load_captured(spark: SparkSession, root: str) -> DataFrame:
    """Captured pages: (url, fetched_at, status, content_type, body, byte_size, verdict).

    Bodies meet the lines of the manifests that `capture_pages` wrote by folder and file. The
    verdict tells whether the body is the recorded one: ok, mismatch, missing or unrecorded.
    Files that no line names are not pages.
    """
    lines = (spark.read.schema(f"folder string, {MANIFEST_DDL}").json(f"{root}/manifests")
             .select("folder", F.explode("files").alias("_f")).select("folder", "_f.*"))
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.body").load(root))
    bodies = raw.select(
        F.regexp_extract("path", r"folder=([^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("content").alias("found"))
    nothing = F.lit(b"")
    body = F.coalesce("found", F.when(F.col("sha256") == content_hash(nothing), nothing))
    joined = lines.join(bodies, ["folder", "file"], "left").withColumn("body", body)
    found = content_hash(F.col("body"))
    return joined.select(
        "url", F.col("collected_at").alias("fetched_at"), F.col("http_status").alias("status"),
        "content_type", "body", F.octet_length("body").cast("long").alias("byte_size"), _verdict(F.col("sha256"), found).alias("verdict"))


def _verdict(recorded: Column, actual: Column) -> Column:
    return (F.when(actual.isNull(), "missing").when(recorded.isNull(), "unrecorded")
            .when(recorded == actual, "ok").otherwise("mismatch"))


def scan_manifests(spark: SparkSession, root: str, name: str = "MANIFEST.json",
                   multi_line: bool = True) -> DataFrame:
    """One row per captured file listed in any manifest below `root`.

    A manifest is one JSON document per file, or one per line without `multi_line`.
    """
    manifests = (spark.read.schema(MANIFEST_DDL).option("multiLine", multi_line)
                 .option("recursiveFileLookup", "true").option("pathGlobFilter", name)
                 .json(root).withColumn("manifest", F.input_file_name()))
    folder = F.regexp_replace("manifest", r"/[^/]+$", "")
    return manifests.select("manifest", folder.alias("folder"), F.explode("files").alias("_f")
                            ).select("manifest", "folder", "_f.*")


def read_bodies(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def verify_digests(manifest: DataFrame, bodies: DataFrame) -> DataFrame:
    """Recorded digest against body: ok, mismatch, missing or unrecorded.

    `manifest`: (path, sha256); `bodies`: (path, content).
    """
    found = bodies.select("path", content_hash(F.col("content")).alias("found_sha256"))
    return manifest.join(found, "path", "left").withColumn(
        "verdict", _verdict(F.col("sha256"), F.col("found_sha256")))
