"""Helpers that every operator of this subpackage shares: reading, shared scratch tables, Arrow mapping."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
LOCAL_SCRATCH = os.path.join(tempfile.gettempdir(), "glyphmill-scratch")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Before Python runs on executors: let workers import this package when only the driver has it on its path, and keep Arrow batches small.

    On a cluster pass the package with --py-files; this line serves a checkout that all machines see.
    """
    # texts are long: batches of the default 10,000 rows would hold tens of MB on both sides
    if int(spark.conf.get(BATCH_CONF, "10000")) == 10_000:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one given to setCheckpointDir; where neither is set (tests, one machine), a folder of our own.

    A folder of one machine serves a local master only, so any other without a checkpoint folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset: master {master} needs a folder that the driver and all executors share")
        at = "file://" + LOCAL_SCRATCH
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/glyphmill-{name}-{uuid.uuid4().hex}"
    if not _clearing:
        _clearing.append(atexit.register(_clear, spark))
    _made.append(path)
    return path


_made: list[str] = []
_clearing: list = []


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
    if path in _made:
        _made.remove(path)


def _clear(spark: SparkSession) -> None:
    for path in list(_made):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session is gone already: nothing is left to do at exit
            return


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    return written_at(df, name, by)[0]


def written_at(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """As written, with the path, for loops that drop what they no longer need."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.write.option("compression", "zstd")
    if by:
        out = out.partitionBy(*by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Passing:
    """Tables of a piece of work in the shared folder, dropped by name as soon as nothing reads them, or all at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As the function written; the name is new or was dropped."""
        out, self.paths[name] = written_at(df, name)
        return out

    def drop(self, *names: str) -> None:
        """Drop tables, all of them without names."""
        for name in names or list(self.paths):
            drop_path(self.spark, self.paths.pop(name))
        self.ended()

    def ended(self) -> None:
        """Let Spark delete the shuffle files of queries that have ended: it does so when the driver collects garbage, which by itself may be much later."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """mapInArrow of a function on single batches; empty batches pass as nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_partitions(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, so further columns never clash. A null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions: what the session asks for."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Bits of a key filter: at least, at most (16 MB), and for each key.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 12, 1 << 27, 16


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(1), t)]


def key_filter(keys: DataFrame) -> tuple[bytes, int]:
    """Bloom filter of rows, four bits each, made by an aggregation; at most MOST_BITS / 8 bytes."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(keys.count(), 1) - 1).bit_length()))
    at = keys.select(F.explode(F.array(*_places([F.col(c) for c in keys.columns], bits))).alias("at"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    rows = at.select(F.shiftright("at", 6).alias("word"), word.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return words.tobytes(), bits


def _places(key: list[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), *key), F.lit(bits)) for k in range(4)]


def holder(keys: DataFrame) -> Callable[[list[Column]], Column]:
    """Makes a condition of key columns by key_filter: true for every row of keys, and for few others."""
    held, bits = key_filter(keys)
    words = keys.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def may_hold(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        w = np.frombuffer(words.value, np.int64)
        hit = np.ones(len(a), bool)
        for at in (a, b, c, d):
            v = at.to_numpy()
            hit &= (w[v >> 6] >> (v & 63)) & 1 == 1
        return pd.Series(hit)

    ship(keys.sparkSession)
    return lambda key: may_hold(*_places(key, bits))


def only(docs: DataFrame, key: list[Column], decided: DataFrame) -> DataFrame:
    """Rows of docs whose key is decided to be kept, all columns as they are. Of rows that share a kept key, one stays.

    key: columns of docs (an id and what stands for the text). decided: those key columns under any names, then kept, a row for each row of docs.
    Of rows that share a kept key, the one whose JSON form sorts first stays. No column name of docs is reserved: the row travels as one struct.

    A filter holds the keys that are dropped or that several rows share. Rows that it doesn't hold pass as they are, without a shuffle;
    the others are joined exactly. So what is shuffled follows what is dropped. Null key parts equal each other. Empty tables: no rows.
    """
    names = [f"k{i}" for i in range(len(key))]
    decided = decided.toDF(*names, "kept")
    per = decided.groupBy(*names).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    odd = written(per.where("not kept or n > 1").select(*names, "kept"), "odd-keys")
    may_hold = holder(odd.select(*names))
    packed = docs.select(F.struct(*(docs[quoted(c)] for c in docs.columns)).alias("row"), *(k.alias(n) for k, n in zip(key, names, strict=True)))
    marked = packed.withColumn("maybe", may_hold([F.col(n) for n in names]))
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"o{n}"))
    checked = marked.where("maybe").join(odd.toDF(*(f"o{n}" for n in names), "kept").hint("merge"), same, "left")
    lone = checked.where("kept is null").select("row")
    shared = checked.where("kept").groupBy(*names).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return marked.where("not maybe").select("row").unionByName(lone).unionByName(shared).select("row.*")
