"""Token ids in files of asymmetric-numeral-system segments, in ascending order of documents.

File format: Parquet rows, so that Spark's commit protocol writes them and a lost executor costs a task, in any store. A row is a
segment: shard, segment, doc_ids (int64), doc_lens (uint32, end ids included), n (ids in all), and the parts of rans.encode:
table, blocks, states, words. Shards follow one another in order of documents, and segments within a shard.

Documents are dealt by range of (id, hash of the text), so one id that many rows share is spread too. A segment closes
behind whole documents when it is full; a task holds one segment at a time. The place of a document in the stream of all ids comes from
the sums of segments: a running sum within each shard, and one over the shards' sums, a row a shard.

Tokens: parts of a text that surely begin a new pre-token are encoded once by the tokenizers library and memoised. The library's own rule
holds for special tokens whose strings stand in a text: they are encoded as those tokens. Such a text goes to the library whole.

Edge cases. Null and empty texts: the end id alone. Long texts: one segment. Repeated rows: each is written. Null ids: first.
Empty table: no files' rows, empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common, rans
from .bpe import LONG, SPLIT, Memo, is_lone, own_pattern

SEGMENT_IDS = 1 << 21
#: Pieces of text that a worker's memo holds, and characters of text that are encoded at a time.
MEMO_PIECES, AT_A_TIME = 1_400_000, 2_000_000
FORMAT = "shard int, segment int, doc_ids binary, doc_lens binary, n long, table binary, blocks binary, states binary, words binary"
_loaded: dict[str, Encoder] = {}


class Numbers(dict):
    """Numbers of strings in order of their first use; fresh lists those that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.count = 0

    def __missing__(self, key: str) -> int:
        n = self[key] = self.count
        self.count = n + 1
        self.fresh.append(key)
        return n


#: Classes of Latin-1 characters: letters and digits, full stop and comma, white space as it is, the rest.
CLASSES = bytes(ord("a") if chr(b).isalnum() else ord("c") if chr(b) in ".," else b if chr(b).isspace() else ord("p") for b in range(256))
#: Begins a part that has no space before it.
BARE = "\x00"


def keys_of(text: str) -> list[str]:
    """Parts of a text that isn't empty, cut where a pre-token surely begins. A part that begins with BARE stands for what follows it,
    any other for itself with a space before. Full stops and commas behind words, and lone line ends, are parts of their own, so
    that the words before them are the same parts everywhere."""
    if is_lone(text) and "\n\n" not in text and BARE not in text:
        try:
            kinds = text.encode("latin-1").translate(CLASSES)
        except UnicodeEncodeError:
            kinds = b"c "
        if kinds.count(b"c ") == kinds.count(b"ac ") and kinds.count(b"c\n") == kinds.count(b"ac\n"):
            text = text.replace(". ", " \x00. ").replace(", ", " \x00, ").replace(".\n", " \x00.\n").replace(",\n", " \x00,\n").replace("\n", " \x00\n \x00")
        return (BARE + text).split(" ")
    return _cut(text)


def _cut(text: str) -> list[str]:
    parts = SPLIT.split(text)
    parts[0] = BARE + parts[0]
    if any(p[:1] == BARE for p in parts[1:]):  # a part of the text itself begins so
        return [BARE + text]
    return parts


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by the tokenizers library.

    A text is cut before lone spaces, where a pre-token surely begins. Each distinct part gets a number when it is first met, and its ids
    once: its pre-tokens go to the library's merge model. The ids of a text are gathered by its parts' numbers. Parts with characters
    beyond PLAIN_UPTO go to the library whole, so its own pre-tokenizer decides on them. A full memo starts anew.
    """

    PLAIN_UPTO = "\u024f"

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.own.get_added_tokens_decoder().values())
        self.merge = self.own.model.tokenize
        self.find = regex.compile(own_pattern(pattern)).findall
        self.mapped = str.maketrans({chr(b): c for b, c in byte_characters().items()})
        self.space = self.mapped[ord(" ")]
        self.piece = Memo(self._piece)
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.pool, self.ends, self.used = np.zeros(1 << 20, "<u4"), np.zeros(1 << 20, np.int64), 0

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and how many each has."""
        if self.number.count >= MEMO_PIECES or self.used and self.ends[self.used - 1] > 8 * MEMO_PIECES:
            self.forget()
        keys: list[str] = []
        upto = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                keys += [BARE + text] if self.holds_special(text) else keys_of(text)
            upto[i + 1] = len(keys)
        number = self.number
        at = np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))
        if number.fresh:
            space, merge, part = self.space, self.merge, self.part
            # most are plain words; the rest takes the general way
            self.add([[t.id for t in merge(space + k)] if k.isascii() and k.isalpha() else part(k) for k in number.fresh])
            for k in number.fresh:
                if len(k) > LONG:
                    del number[k]
            number.fresh = []
        start = np.where(at > 0, self.ends[at - 1], 0)
        n = self.ends[at] - start
        ends = np.concatenate([[0], np.cumsum(n)])
        out = self.pool[np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)]
        return out, np.diff(ends[upto])

    def holds_special(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def part(self, key: str) -> list[int]:
        text = key[1:] if key[0] == BARE else " " + key
        if not text:
            return []
        if max(text) > self.PLAIN_UPTO or self.holds_special(text):
            return self.own.encode(text, add_special_tokens=False).ids
        if key.isalpha():
            return self._piece(text)
        return [i for p in self.find(text) for i in self.piece[p]]

    def _piece(self, piece: str) -> list[int]:
        if piece.isascii() and piece[1:].isalnum() and (piece[0] == " " or piece[0].isalnum()):
            mapped = self.space + piece[1:] if piece[0] == " " else piece
        else:
            mapped = piece.encode().decode("latin-1").translate(self.mapped)
        return [t.id for t in self.merge(mapped)]

    def add(self, found: list[list[int]]) -> None:
        base = int(self.ends[self.used - 1]) if self.used else 0
        ids = np.fromiter(chain.from_iterable(found), "<u4")
        while len(self.ends) < self.used + len(found):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.pool) < base + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[base : base + len(ids)] = ids
        self.ends[self.used : self.used + len(found)] = base + np.cumsum([len(x) for x in found])
        self.used += len(found)


def encoder(path: str, pattern: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path, pattern)
    return _loaded[path]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about AT_A_TIME bytes of text, a row at least."""
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_A_TIME, "right")))
        yield batch.slice(at, to - at)
        at = to


def write_ids(docs: DataFrame, out: str, path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode texts and write them to the folder out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        shard, segment = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int] = []
        lens: list[int] = []

        def close() -> pa.RecordBatch:
            made = rans.encode(np.concatenate(ids))
            row = {"shard": shard, "segment": segment, "doc_ids": np.array(docs, "<i8").tobytes(), "doc_lens": np.array(lens, "<u4").tobytes(), "n": sum(lens)} | {k: made[k] for k in ("table", "blocks", "states", "words")}
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for part in slices(batch):
                got, n = own.ids(part.column(1).to_pylist())
                got = np.insert(got, np.cumsum(n), end_id)
                docs += part.column(0).fill_null(NULL_ID).to_pylist()
                lens += (n + 1).tolist()
                ids.append(got)
                if sum(map(len, ids)) >= segment_ids:
                    yield close()
                    segment, ids, docs, lens = segment + 1, [], [], []
        if lens:
            yield close()

    rows = common.id_text(docs, id_col, text_col)
    spread = F.xxhash64("text")
    rows = rows.repartitionByRange(common.partitions_for(docs), F.col("doc_id"), spread).sortWithinPartitions("doc_id", spread)
    common.map_partitions(rows, run, FORMAT).write.option("compression", "none").parquet(out)


#: Stands for a null id in a file.
NULL_ID = -(1 << 63)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and with with_ids the ids of each document, from the files of a folder."""
    files = spark.read.schema(FORMAT).parquet(folder)
    extra = ", ids array<int>" * with_ids

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for row in batch.to_pylist():
            ids = rans.decode(row)
            docs, lens = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_lens"], "<u4").astype(np.int64)
            ends, raw = np.cumsum(lens), memoryview(ids.astype("<u4").tobytes())
            cols[0] += [row["shard"]] * len(docs)
            cols[1] += [row["segment"]] * len(docs)
            cols[2] += [None if d == NULL_ID else d for d in docs.tolist()]
            cols[3] += (ends - lens).tolist()
            cols[4] += lens.tolist()
            cols[5] += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
            if with_ids:
                cols[6] += [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 + with_ids]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], ["shard", "segment", "doc_id", "within", "n_tokens", "ids_crc32", "ids"][: 6 + with_ids])

    docs = common.map_batches(files, f, "shard int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long" + extra)
    sums = files.select("shard", "segment", "n")
    before = W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    shards = sums.groupBy("shard").agg(F.sum("n").alias("all"))
    shards = shards.select("shard", F.coalesce(F.sum("all").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shard_base"))
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(shards, "shard")
    bases = common.written(bases.select("shard", "segment", (F.col("base") + F.col("shard_base")).cast("long").alias("base")), "ids-bases")
    out = docs.join(bases, ["shard", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch_path(spark, "token-files")
    write_ids(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_ids(spark, folder)
