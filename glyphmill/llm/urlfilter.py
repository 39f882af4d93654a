"""URL filter: a blocked Bloom filter of listed entries, then an exact hash join of the possible hits.

A list entry is (host, path, verdict). It fits its host and all subdomains of it, if the url's path starts with the entry's
path; the longest entry wins. A url therefore has one key for each listed number of host labels and each listed path length, however many
labels its host has.
The keys are hashed once; the filter's blocks are 256 bits, all bits of a key lie in one block. Keys that pass go to a join on
the key itself, which removes the filter's false positives. A url without an entry gets the default verdict.

The filter is built by an aggregation over the list and is at most MAX_BLOCKS * 32 bytes; a longer list passes more false
positives. The list is broadcast for the join only up to BROADCAST_ROWS rows, counted; beyond, both sides are shuffled by
(key, salt), the list once for each salt, so a host with a third of all pages spreads over SALTS tasks.

Edge cases. Null url or no "://": host and path are empty, no entry fits. Repeated entries: one of them counts, block before allow.
Repeated pages give repeated rows. Empty list: every url gets the default. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MAX_BLOCKS = 1 << 19
BROADCAST_ROWS = 100_000
SALTS = 16


def host_of(url: F.Column) -> F.Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), common.UPPER, common.LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def place(key: F.Column, blocks: int) -> list[F.Column]:
    """Block number and the four 64-bit masks of a key: two bits in each."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bit = lambda h, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, k).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return [F.pmod(a, F.lit(blocks)).cast("int").alias("block"), *(bit(b, 12 * w).bitwiseOR(bit(b, 12 * w + 6)).alias(f"w{w}") for w in range(4))]


def build_filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """blocks x 4 words. keys: column key."""
    rows = keys.select(*place(F.col("key"), blocks)).groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(4))).toArrow()
    out = np.zeros((blocks, 4), np.int64)
    at = rows.column("block").to_numpy()
    for w in range(4):
        out[at, w] = rows.column(f"w{w}").to_numpy()
    return out


def judge(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, a row for each row of pages. entries: host, path, verdict."""
    spark = pages.sparkSession
    entries = entries.select(F.translate("host", common.UPPER, common.LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    entries = entries.groupBy(F.concat("host", "path").alias("key")).agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict", F.length("path").alias("len"), (F.regexp_count("host", F.lit(r"\.")) + 1).alias("labels"))).alias("e"))
    entries = entries.select("key", F.col("e.verdict").alias("listed"), F.col("e.len").alias("len"), F.col("e.labels").alias("labels"))
    entries = common.written(entries, "url-list")
    count = entries.count()
    blocks = min(MAX_BLOCKS, max(1, 1 << (count // 16).bit_length()))
    held = spark.sparkContext.broadcast(build_filter(entries, blocks).tobytes())
    # lengths of paths and numbers of labels, not paths and hosts
    lengths = sorted(r[0] for r in entries.select("len").distinct().collect())
    labels = sorted(r[0] for r in entries.select("labels").distinct().collect())

    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    # with fewer labels than n it is the whole host, which is a key of its own length too
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]).cast("array<string>")))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    base = base.withColumn("keys", keys)
    hashed = lambda w: lambda k: place(k, blocks)[w].cast("long")
    for w in range(5):  # hashes of the keys, beside them
        base = base.withColumn(f"h{w}", F.transform("keys", hashed(w)))
    schema = "page_id long, host string, path string, keys array<string>"

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = np.frombuffer(held.value, np.int64).reshape(blocks, 4)
        col = dict(zip(batch.schema.names, batch.columns, strict=True))
        flat = [col[f"h{w}"].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for w in range(5)]
        hit = np.ones(len(flat[0]), bool)
        for w in range(4):
            hit &= (words[flat[0], w] & flat[w + 1]) == flat[w + 1]
        sizes = np.asarray(col["keys"].value_lengths().fill_null(0))
        ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])]
        kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), col["keys"].flatten().filter(pa.array(hit)))
        return pa.RecordBatch.from_arrays([col["page_id"], col["host"], col["path"], kept], ["page_id", "host", "path", "keys"])

    probed = common.map_batches(base.withColumn("page_id", F.col("page_id").cast("long")), probe, schema)
    probed = common.written(probed.withColumn("row", F.monotonically_increasing_id()), "url-probed")
    none = probed.where(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = probed.where(F.size("keys") > 0).select("row", "page_id", "host", "path", F.explode("keys").alias("key"))
    if count <= broadcast_rows:
        joined = hits.join(F.broadcast(entries), "key", "left")
    else:
        salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    best = F.max(F.when(F.col("listed").isNotNull(), F.struct(F.length("key").alias("n"), "key", "listed"))).alias("best")
    found = joined.groupBy("row", "page_id", "host", "path").agg(best)
    found = found.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.listed", F.lit(default)).alias("verdict"))
    return none.unionByName(found)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(common.table(spark, sf_dir, "pages"), rules)
