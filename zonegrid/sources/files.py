"""File-level jobs: checksum manifest and output inventory.

Both are Spark jobs over the ``binaryFile`` source: files, and byte ranges of large
ones, are spread over tasks, checksums run next to the data, and only the small
per-file result table reaches the driver when the caller asks for it.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "name string, sha256 string, bytes long, path string"


RANGE_BYTES = 256 * 1024 * 1024
PIECE_BYTES = 4 * 1024 * 1024


def range_digests(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """``ranges`` (path, bytes, start) with the SHA-256 of up to ``range_bytes`` bytes from
    ``start``; a task holds one piece of a file at a time."""
    piece = PIECE_BYTES

    def run(batches):
        import hashlib
        import re

        import pandas as pd
        from pyarrow import fs

        def digest(path, start, end):
            local = re.match("file:/+", path)
            store, name = (fs.LocalFileSystem(), "/" + path[local.end():]) if local else fs.FileSystem.from_uri(path)
            found = hashlib.sha256()
            with store.open_input_file(name) as f:
                f.seek(start)
                while start < end:
                    data = f.read(min(piece, end - start))
                    if not data:
                        raise OSError(f"{path} ends at {start}, before {end}")
                    found.update(data)
                    start += len(data)
            return found.hexdigest()

        for pdf in batches:
            ends = [min(s + range_bytes, b) for s, b in zip(pdf["start"], pdf["bytes"])]
            yield pd.DataFrame({"path": pdf["path"], "bytes": pdf["bytes"], "start": pdf["start"],
                                "digest": [digest(*x) for x in zip(pdf["path"], pdf["start"], ends)]})

    return ranges.mapInPandas(run, "path string, bytes long, start long, digest string")


def file_checksums(spark: SparkSession, folder: str, glob: str = "*.parquet",
                   range_bytes: int = RANGE_BYTES) -> DataFrame:
    """name, sha256, bytes, path for every matching file, whose content is read once.

    Up to ``range_bytes`` it is the file's SHA-256. A longer file is read in ranges of that
    size, each by a task of its own, and has the SHA-256 of the ranges' hexadecimal
    digests in order: compare such values only at the same ``range_bytes``. Files without
    content are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    whole = files.where(F.col("length") <= range_bytes).select(
        "path", F.sha2(F.col("content"), 256).alias("sha256"), F.col("length").alias("bytes"))
    ranges = (files.where(F.col("length") > range_bytes)
              .select("path", F.col("length").alias("bytes"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1,
                                           F.lit(range_bytes).cast("long"))).alias("start"))
              .repartition("path", "start"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))),
                                      lambda r: r["digest"]), "")
    long = range_digests(ranges, range_bytes).groupBy("path", "bytes").agg(F.sha2(joined, 256).alias("sha256"))
    return whole.unionByName(long).select(F.element_at(F.split("path", "/"), -1).alias("name"),
                                          "sha256", "bytes", "path")


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (name, sha256) is not in the manifest (J5: anti-join)."""
    return current.join(manifest.select("name", "sha256"), ["name", "sha256"], "left_anti")


def manifest_status(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every current file with status new / changed / unchanged against the manifest."""
    m = manifest.select("name", F.col("sha256").alias("_old"))
    status = (F.when(F.col("_old").isNull(), F.lit("new"))
              .when(F.col("_old") == F.col("sha256"), F.lit("unchanged")).otherwise(F.lit("changed")))
    return current.join(m, "name", "left").withColumn("status", status).drop("_old")


def is_missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest checksum of every file recorded so far; empty if nothing is."""
    try:
        seen = spark.read.parquet(path)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    last = F.max_by(F.struct("sha256", "bytes", "path"), "seen_at").alias("last")
    return seen.groupBy("name").agg(last).select("name", "last.*")


def write_manifest(current: DataFrame, path: str) -> None:
    """Record the checksums of ``current``; earlier records stay as history."""
    (current.select("name", "sha256", "bytes", "path", F.current_timestamp().alias("seen_at"))
     .write.mode("append").parquet(path))


def refresh_manifest(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """Status of every file against the manifest, which then records the new and changed
    ones. Checksums are written once, next to the manifest, and read for both."""
    found = manifest_status(file_checksums(spark, folder), read_manifest(spark, manifest))
    path = f"{manifest.rstrip('/')}-status"
    found.write.mode("overwrite").parquet(path)
    status = spark.read.parquet(path)
    fresh = status.where(F.col("status") != "unchanged")
    if fresh.limit(1).count():
        write_manifest(fresh, manifest)
    return status


def folder_fingerprint(spark: SparkSession, folder: str) -> str:
    """Number and combined hash of the files below ``folder`` (path, size, time), listed
    by Spark; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(folder).select("path", "length", "modificationTime"))
    n, mixed = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{n}:{mixed}"


def output_inventory(spark: SparkSession, base: str, expected: dict) -> DataFrame:
    """Expected datasets present? total size in MB of their Parquet files.

    Only ``path`` and ``length`` are selected, so file contents are never read.
    Each file is mapped to its dataset by path prefix, then equi-joined to the
    expected list.
    """
    base = base.rstrip("/")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(base).select("path", "length"))
    rel = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(base.split("://")[-1]) + "/", "")
    dataset = F.lit(None).cast("string")
    for name, location in expected.items():
        dataset = F.when(rel.startswith(location + "/"), F.lit(name)).otherwise(dataset)
    sized = files.select(dataset.alias("dataset"), "length").where(F.col("dataset").isNotNull())
    per = sized.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
    want = spark.createDataFrame([(k,) for k in expected], "dataset string")
    return want.join(per, "dataset", "left").select(
        "dataset", F.coalesce(F.col("n_files") > 0, F.lit(False)).alias("present"),
        F.round(F.coalesce(F.col("bytes"), F.lit(0)) / (1024 * 1024), 2).alias("size_mb"))
