"""Benchmark folders and annotation sources: <root>/gt/<id>.json, <root>/images/<id>.png, manifest.json, and one reader a format."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import warnings
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..operators import annotations as A


def images(spark: SparkSession, *paths: str) -> DataFrame:
    """sample_id, path, height, width, n_channels, data (blue, green, red rows). An undecodable file is an error when it is read."""
    d = spark.read.format("image").option("dropInvalid", False).load(list(paths)).select("image.*")
    bad = F.raise_error(F.concat(F.lit("undecodable image: "), "origin"))
    d = d.withColumn("data", F.when(F.col("width") < 1, bad.cast("binary")).otherwise(F.col("data")))
    return d.select(stem(F.col("origin")).alias("sample_id"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data")


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths that match the patterns, in order; a pattern that matches nothing counts as a plain path, and with none there either is a warning."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for pattern in patterns:
        at = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = at.getFileSystem(conf)
        found = sorted(str(x.getPath()) for x in fs.globStatus(at) or [])
        if not found and any(c in pattern for c in "*?[{"):
            literal = jvm.org.apache.hadoop.fs.Path(re.sub(r"([*?\[\]{}])", r"\\\1", pattern))
            found = sorted(str(x.getPath()) for x in fs.globStatus(literal) or [])
        if not found:
            warnings.warn(f"no match for {pattern!r}", stacklevel=2)
        out += found
    return out


def limited(samples: DataFrame, limit: int | None) -> DataFrame:
    """The first samples in order of their ids."""
    return samples if limit is None else samples.orderBy("sample_id").limit(limit)


def stem(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """sample_id, path of the files of a folder; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(stem(F.col("path")).alias("sample_id"), "path")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, sub: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{sub}")
        return at.getFileSystem(conf).exists(at)

    def read(self) -> DataFrame:
        """Samples in order of their ids; none where the folder is missing."""
        if not self._there("gt"):
            return self.spark.createDataFrame([], schemas.SAMPLE)
        at = self.spark.read.option("recursiveFileLookup", True)
        one = at.schema(schemas.SAMPLE).option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{self.root}/gt")  # a file a sample
        many = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(f"{self.root}/gt")  # as written here
        return A.from_json(A.to_json(one).select("json").unionByName(many.withColumnRenamed("value", "json"))).orderBy("sample_id")

    def sample_ids(self) -> DataFrame:
        return self.read().select("sample_id")

    def write(self, samples: DataFrame) -> None:
        """A JSON line a sample, by source; repeated writes replace all."""
        A.to_json(samples).join(samples.select("sample_id", "source"), "sample_id").select("source", F.col("json").alias("value")).write.mode("overwrite").partitionBy("source").text(f"{self.root}/gt")

    def images(self) -> DataFrame:
        return listing(self.spark, f"{self.root}/images") if self._there("images") else self.spark.createDataFrame([], "sample_id string, path string")

    def manifest(self) -> DataFrame:
        return A.manifest(self.read(), self.images())

    def save_run(self, run_id: str, tables: dict[str, DataFrame], about: dict, report: str) -> str:
        """Results of a run under results/<run_id>: a folder of JSON lines for each table, about.json and summary.md. Returns the folder."""
        folder = f"{self.root}/results/{run_id}"
        for name, d in tables.items():
            d.write.mode("overwrite").json(f"{folder}/{name}")
        self._put(f"{folder}/about.json", json.dumps(about, indent=1))
        self._put(f"{folder}/summary.md", report)
        return folder

    def _put(self, path: str, text: str) -> None:
        """A small file of the driver's, through the store's own file system."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(conf).create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def put_images(self, pictures: DataFrame, folder: str = "images") -> None:
        """Write sample_id, png as files <folder>/<sample_id>.png: tasks write through the store's file system, a repeated task replaces its files."""
        root = f"{self.root}/{folder}"
        local = root.removeprefix("file://") if root.startswith("file:") or "://" not in root else None
        if local is None:
            raise ValueError("pictures are written to a folder that all machines mount")
        os.makedirs(local, exist_ok=True)

        def save(rows) -> None:
            for r in rows:
                part = f"{local}/.{r.sample_id}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(bytes(r.png))
                os.replace(part, f"{local}/{r.sample_id}.png")

        pictures.foreachPartition(save)

    def write_manifest(self) -> None:
        self.manifest().coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest")


def read_receipts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return limited(A.validated(A.from_receipts(spark.read.schema(schemas.RECEIPT).json(path))), limit)


def read_forms(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    raw = spark.read.schema(schemas.FORM).option("multiLine", True).json(path).withColumn("stem", stem(F.input_file_name()))
    return limited(A.validated(A.from_forms(raw)), limit)


def read_cheques(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return limited(A.validated(A.from_cheques(spark.read.schema(schemas.CHEQUE).json(path))), limit)


def read_identity(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    raw = spark.read.schema(schemas.IDENTITY).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    return limited(A.validated(A.from_identity(raw.withColumn("stem", stem(F.col("path"))))), limit)


def read_char_boxes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON-lines export; pickled archives are never opened."""
    raw = spark.read.schema(schemas.CHAR_BOXES).json(path).withColumn("page", stem(F.input_file_name()))
    return limited(A.validated(A.from_char_boxes(raw)), limit)


def png(data: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG file of rows of gray or of blue, green, red bytes."""
    import numpy as np

    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    a = a[..., ::-1] if channels == 3 else a
    rows = np.concatenate([np.zeros((height, 1), np.uint8), a.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def encoded(rasters: DataFrame) -> DataFrame:
    """sample_id, png of rasters (sample_id, height, width, n_channels, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            made = [png(r["data"], r["height"], r["width"], r["n_channels"]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["sample_id", "png"])

    return rasters.select("sample_id", "height", "width", "n_channels", "data").mapInArrow(run, "sample_id string, png binary")
