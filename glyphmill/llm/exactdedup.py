"""Exact dedup with a log-structured merge index of digests.

1. A log of (id, sha256 of the normalised text) is written, so the texts are hashed once.
2. Each task puts its part of the log into a memtable. A full memtable is flushed as a run sorted by digest
   that keeps one identifier and a count a digest. Each task also fills two Bloom filters of one shape:
   `once` (digests seen) and `twice` (digests seen again). Filters of tasks merge by
   (o1 | o2, t1 | t2 | o1 & o2), so `twice` of all tasks holds every digest that occurs more than once.
3. A digest that is not in `twice` is proven single and is never shuffled. Compaction deals the entries of the other
   digests by digest, merges the sorted runs in order and streams over them: entries of one digest become one, with the smallest (or, as
   here asked for, the largest) identifier and the sum of the counts. The compacted run is the index.
4. Hits are verified byte by byte. A second filter, of the index alone, picks the texts; the text of each row of a group is
   compared with the text of the row that stays. Rows that fail (a digest collision) are grouped anew by their whole bytes.

A filter's size follows what it holds up to MAX_FILTER_BITS; beyond that it passes more false hits, which cost
shuffle but change nothing: of the first filter digests and ids alone, of the second, which holds only digests that do repeat, texts. Slices of filters are merged by streaming over
them. Hot digests: runs hold a row a digest and task, and the join of hits with the index is an ordinary
sort-merge join, whose skewed partitions adaptive execution splits.

An index may be kept and grown: extend adds the log of further documents to a folder of runs as a new level, compacts all levels into one where there are
MOST_LEVELS, and says which of the documents repeat a text that the index or the batch has.

Edge cases. Null text: empty text, equal to other empty ones. Null ids: the group keeps its largest (smallest) id that is not null.
Repeated rows (the same id and text): one of them is kept. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MEMTABLE_ROWS = 65_536
MIN_FILTER_BITS, MAX_FILTER_BITS, BITS_A_ROW = 1 << 14, 1 << 27, 16
SLICE_BYTES = 1 << 16
HASHES = 4
#: Levels of a kept index, above which they are compacted into one.
MOST_LEVELS = 4


def normalised(text: bytes) -> bytes:
    """Lower-cases A-Z only."""
    return text.lower()


def digest_of(raw: bytes, size: int = 32) -> bytes:
    return hashlib.sha256(raw).digest()[:size]


def filter_bits(rows: int) -> int:
    return min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (BITS_A_ROW * max(rows, 1) - 1).bit_length()))


def places(digests: list[bytes], bits: int) -> np.ndarray:
    """Bit numbers of each digest: a row a digest."""
    raw = b"".join(d if len(d) == 32 else hashlib.sha256(d).digest() for d in digests)
    return (np.frombuffer(raw, dtype="<u8").reshape(-1, HASHES) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    """Bloom filter; every one that is merged has the same number of bits."""

    def __init__(self, bits: int, raw: bytes | None = None):
        self.bits = bits
        self.words = np.zeros(bits // 8, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)

    def add(self, digests: list[bytes]) -> None:
        if digests:
            at = places(digests, self.bits).ravel()
            np.bitwise_or.at(self.words, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        at = places(digests, self.bits)
        return ((self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def log_of(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int = 32) -> DataFrame:
    """doc_id, digest, text_sha256 of every row, written."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        full = [hashlib.sha256(normalised(x)).digest() for x in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[:digest_bytes] for x in full], pa.binary()), pa.array(full, pa.binary())], ["doc_id", "digest", "sha"])

    return common.written(common.map_batches(common.id_text(docs, id_col, text_col), f, "doc_id long, digest binary, sha binary"), "lsm-log")


def flush_runs(log: DataFrame, bits: int, keep: str, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Sorted runs and filter slices. kind run: run, digest, id, n; kind filter: slice, once, twice."""
    better = max if keep == "largest" else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        once, twice = Filter(bits), Filter(bits)
        names = ["kind", "run", "digest", "id", "n", "slice", "once", "twice"]

        def flush() -> pa.RecordBatch:
            keys = sorted(table)
            seen = once.has(keys)
            twice.add([k for k, again in zip(keys, seen, strict=True) if again or table[k][1] > 1])
            once.add(keys)
            m, name = len(keys), uuid.uuid4().hex
            cols = [pa.array(["run"] * m), pa.array([name] * m), pa.array(keys, pa.binary()), pa.array([table[k][0] for k in keys], pa.int64()), pa.array([table[k][1] for k in keys], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())]
            table.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        some = False
        for batch in batches:
            for d, i in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                e = table.get(d)
                if e is None:
                    if len(table) >= memtable_rows:
                        yield flush()
                    table[d] = [i, 1]
                else:
                    e[0] = i if e[0] is None else e[0] if i is None else better(e[0], i)
                    e[1] += 1
                some = True
        if table:
            yield flush()
        if some:
            parts = slices_of(once.words, twice.words)
            m = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(["filter"] * m), pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names)

    out = common.map_partitions(log.select("doc_id", "digest"), run, "kind string, run string, digest binary, id long, n long, slice int, once binary, twice binary")
    return common.written(out, "lsm-runs", by=("kind",))


def slices_of(once: np.ndarray, twice: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Number and compressed bytes of the slices of two filters of one size, but those where nothing is set."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for k in range(0, len(once), SLICE_BYTES):
        o, t = once[k : k + SLICE_BYTES], twice[k : k + SLICE_BYTES]
        if o.any():
            out.append((k // SLICE_BYTES, z.compress(o.tobytes()), z.compress(t.tobytes())))
    return out


def merged_filter(slices: DataFrame, bits: int, which: str = "twice") -> Filter:
    """A filter over all tasks from slices (slice, once, twice): what occurs once or more, or twice or more. Each slice merges by streaming over
    its parts; the driver receives at most MAX_FILTER_BITS / 8 bytes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, c = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        at, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            raw = c.compress((twice if which == "twice" else once).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([raw], pa.binary())], ["slice", "words"])

        for batch in batches:
            for k, *raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                o, t = (np.frombuffer(z.decompress(x), np.uint8) for x in raw)
                if k == at:
                    once, twice = once | o, twice | t | (once & o)
                else:
                    if at is not None:
                        yield done()
                    at, once, twice = k, o, t
        if at is not None:
            yield done()

    parts = slices.select("slice", "once", "twice").repartition(common.partitions_for(slices), "slice").sortWithinPartitions("slice")
    out, z = Filter(bits), zstandard.ZstdDecompressor()
    for k, raw in common.map_partitions(parts, merge, "slice int, words binary").collect():
        x = z.decompress(raw)
        out.words[k * SLICE_BYTES : k * SLICE_BYTES + len(x)] = np.frombuffer(x, np.uint8)
    return out


def filter_of(entries: DataFrame, rows: int) -> Filter:
    """A filter of the column digest."""
    bits = filter_bits(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            own.add(batch.column(0).to_pylist())
        parts = slices_of(own.words, own.words)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], ["slice", "once", "twice"])

    return merged_filter(common.map_partitions(entries.select("digest"), run, "slice int, once binary, twice binary"), bits, "once")


def maybe(df: DataFrame, held: Filter) -> DataFrame:
    """df with a column `maybe`: whether the filter may hold the row's digest."""
    raw, bits = df.sparkSession.sparkContext.broadcast(held.words.tobytes()), held.bits
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", maybe boolean"
    at = df.columns.index("digest")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = Filter(bits, raw.value).has(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "maybe"])

    return common.map_batches(df, f, schema)


def merged_runs(entries: DataFrame, keep: str) -> DataFrame:
    """Sorted runs of entries (digest, id, n) merged into one run a partition, an entry a digest; constant memory."""
    better = max if keep == "largest" else min

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, count = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for digest, i, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest == at:
                    best = i if best is None else best if i is None else better(best, i)
                    count += n
                else:
                    if at is not None:
                        out.append((at, best, count))
                    at, best, count = digest, i, n
            yield entries_batch(out)
        if at is not None:
            yield entries_batch([(at, best, count)])

    dealt = entries.select("digest", "id", "n").repartition(common.partitions_for(entries), "digest").sortWithinPartitions("digest")
    return common.map_partitions(dealt, merge, "digest binary, id long, n long")


def entries_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "id", "n"])


def compact(runs: DataFrame, held: Filter, keep: str) -> DataFrame:
    """One entry a digest that occurs more than once: digest, keep_id, n."""
    entries = maybe(runs.where("kind = 'run'").select("digest", "id", "n"), held).where("maybe")
    return common.written(merged_runs(entries, keep).where("n > 1").withColumnRenamed("id", "keep_id"), "lsm-index")


def extend(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", most_levels: int = MOST_LEVELS) -> DataFrame:
    """doc_id, seen, keep_id of every row of docs against the index kept in folder, which then holds docs too.

    seen: an earlier batch has the text. keep_id: the identifier that stays of the text, over all batches. Decided by the whole sha256. Each batch is a
    level of sorted runs (digest, id, n); where there are most_levels, they are merged into one. Levels are written under new names before older ones go, so a
    failed run leaves an index that can be read. Null texts count as empty; null ids give way to others; an empty batch adds nothing.
    """
    spark = docs.sparkSession
    log = log_of(docs, id_col, text_col)
    old = levels(spark, folder)
    runs = flush_runs(log, MIN_FILTER_BITS, keep).where("kind = 'run'").select("digest", "id", "n")
    runs.write.parquet(f"{folder.rstrip('/')}/level-{len(old):04d}-{uuid.uuid4().hex}")
    earlier = spark.read.schema("digest binary, id long, n long").parquet(*old) if old else runs.limit(0)
    known = earlier.select("digest").distinct().withColumn("seen", F.lit(True))
    best = merged_runs(earlier.unionByName(runs), keep).select("digest", F.col("id").alias("keep_id"))
    out = common.written(log.join(known, "digest", "left").join(best, "digest").select("doc_id", F.coalesce("seen", F.lit(False)).alias("seen"), "keep_id"), "lsm-extended")
    if len(old) + 1 >= most_levels:
        everything = levels(spark, folder)
        merged_runs(spark.read.schema("digest binary, id long, n long").parquet(*everything), keep).write.parquet(f"{folder.rstrip('/')}/level-0000-{uuid.uuid4().hex}")
        for path in everything:
            common.drop_path(spark, path)
    return out


def levels(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the levels of a kept index."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    return sorted(str(x.getPath()) for x in fs.listStatus(at) if x.getPath().getName().startswith("level-")) if fs.exists(at) else []


def hit_texts(docs: DataFrame, id_col: str, text_col: str, held: Filter, digest_bytes: int) -> DataFrame:
    """doc_id, digest, sha, raw (normalised bytes) of the rows that the filter passes."""
    words, bits = docs.sparkSession.sparkContext.broadcast(held.words.tobytes()), held.bits

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normalised(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        full = [hashlib.sha256(x).digest() for x in texts]
        mask = Filter(bits, words.value).has([x[:digest_bytes] for x in full])
        at = np.flatnonzero(mask).tolist()
        cols = [batch.column(0).filter(pa.array(mask)), pa.array([full[i][:digest_bytes] for i in at], pa.binary()), pa.array([full[i] for i in at], pa.binary()), pa.array([texts[i] for i in at], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "sha", "raw"])

    return common.map_batches(common.id_text(docs, id_col, text_col), f, "doc_id long, digest binary, sha binary, raw binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, a row for each row of docs.

    keep: "smallest" or "largest" identifier of equal texts. digest_bytes: fewer than 32 only to test collisions.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}")
    log = log_of(docs, id_col, text_col, digest_bytes)
    bits = filter_bits(log.count())
    runs = flush_runs(log, bits, keep, memtable_rows)
    held = merged_filter(runs.where("kind = 'filter'"), bits)
    index = compact(runs, held, keep)
    held = filter_of(index, index.count())  # only what does repeat: so false hits of the first filter cost no texts

    single = maybe(log, held).where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    # the text that stays of each digest: joined by digest and id, so that a large group is no large key
    reps = hit_texts(docs, id_col, text_col, held, digest_bytes).withColumnRenamed("digest", "_d")
    reps = index.join(reps, (F.col("digest") == F.col("_d")) & F.col("keep_id").eqNullSafe(F.col("doc_id")))
    reps = reps.groupBy("digest", "keep_id", "n").agg(F.first("raw").alias("kept_raw"))
    same = F.col("n").isNull() | F.coalesce(F.col("raw") == F.col("kept_raw"), F.lit(False))
    hits = hit_texts(docs, id_col, text_col, held, digest_bytes).join(reps, "digest", "left")
    checked = hits.select("doc_id", "digest", "sha", "keep_id", "n", same.alias("same"), F.when(~same, F.col("raw")).alias("raw"), F.monotonically_increasing_id().alias("row"))
    checked = common.written(checked, "lsm-checked")
    return single.unionByName(_groups(checked, keep)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _groups(checked: DataFrame, keep: str) -> DataFrame:
    alone = checked.where("n is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    groups = checked.where("n is not null")
    failed = groups.where("not same")
    if not failed.isEmpty():  # digest collisions: group by the bytes themselves
        best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
        again = failed.groupBy("raw").agg(best.alias("k"), F.count("*").alias("m"))
        wrong = failed.groupBy("digest").agg(F.count("*").alias("wrong"))
        right = groups.where("same").join(wrong, "digest", "left").withColumn("n", F.col("n") - F.coalesce("wrong", F.lit(0))).drop("wrong")
        bad = failed.join(again, "raw").withColumn("keep_id", F.col("k")).withColumn("n", F.col("m")).drop("k", "m")
        groups = right.unionByName(bad.select(*right.columns))
    group = [F.col("digest"), F.col("raw")]
    first = groups.where("doc_id <=> keep_id").groupBy(*group).agg(F.min("row").alias("first")).select("first")
    groups = groups.join(first, F.col("row") == F.col("first"), "left")
    return alone.unionByName(groups.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("first").isNotNull().alias("kept"), "sha"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs without the rows that dedup drops, all columns as they are; one row stays of each text. Edge cases as in dedup and common.only."""
    decided = common.written(dedup(docs, id_col, text_col, keep).select("doc_id", "text_sha256", "kept"), "lsm-decided")
    text = F.coalesce(docs[common.quoted(text_col)].cast("string"), F.lit(""))
    key = [docs[common.quoted(id_col)].cast("long"), F.sha2(F.translate(text, common.UPPER, common.LOWER).cast("binary"), 256)]
    return common.only(docs, key, decided)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
