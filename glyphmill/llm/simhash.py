"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints: a bit is 1 if it is set in over half of the hashes of a text's word shingles. Two fingerprints link at MOST or
fewer differing bits.

Candidates. A fingerprint is cut into 32 segments of two bits; the vector of the segments' bit counts is its embedding. The
Manhattan distance of two embeddings is at most the Hamming distance, so linked fingerprints are at most MOST apart. With the
segments in two halves, one half is then at most MOST // 2 = 2 apart, and there is a grid point within 1 of both.
Each fingerprint therefore posts itself, for each half, at every grid point within 1 of it; linked ones share a point. Posts are dealt
by grid point, and what shares a point is verified by the exact Hamming distance.

Only distinct fingerprints post, so copies cost nothing. Within a point no pairs leave the task: a search over what is not yet
reached gives a spanning forest of the links, whose components are those of all links. So a dense group of n costs n - 1 edges.
Components then follow from alternating large-star and small-star steps on the edges, whose rows never grow, each step
written to the shared folder.

Shares of shingles. Four bits of 64 are a very high similarity: shingle sets that share 0.8 of their shingles differ in 8 to 10 bits. Where a
share of shingles is asked for (the corpus pipeline), similar_groups takes its first candidates from the fingerprints, finds the pairs that these
can't reach by the shingle sets, and decides all by counting, without loss:
0. Fingerprints. All above, from fingerprints to components: what hangs together by links is one group of candidates.
1. Prefixes, for pairs of different groups. In one order of all shingles, two sets with a Jaccard similarity of 0.8 or more share one of their first n - ceil(0.8 n) + 1. Each
distinct set posts itself at these. The order puts shingles that a sample finds often last, so common lines are seldom posted;
the answer doesn't depend on the order. A post tells the set's size and the shingle's place in it. At the first shingle that two sets share, what follows in
either holds all that they share; a post goes on only where that is enough with one of another group, so chance meetings end at the first exchange.
2. Sketches. A set's sketch has a bit for each of 512 parts of the hashes, of more where it is large: the parity of its count. Sketches of one
width differ in at most as many bits as the sets differ in shingles; a wider one is folded to half its width. So a pair at one post that differs in more bits than 0.8 allows for its sizes, or whose sizes alone rule 0.8 out, is no
link; the others are candidates, and a forest of them has the components of all candidates.
3. Sets. Components of candidates are cut to those of true links by counting what exact shingle sets share. A component of up to PART shingles in
all meets in a task. A larger one is never gathered: its hub (the text with the most candidate edges) goes to parts of its texts, and what
links with the hub is one component already. Only what doesn't is compared with the rest, a part with a part, so a family of near
copies costs a comparison each, and a task holds two parts. Sets hold 64-bit hashes of shingles.

Edge cases. Null and empty texts, or white space alone: fingerprint zero, linked like any other. Fewer words than a shingle: the whole
sequence is the one shingle. Null ids: they take part, and the smallest id that is not null names the component. Repeated rows: each is
returned. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MOST = 4
SEED = 42
CHUNK = 1 << 16
#: Least Jaccard similarity of similar_groups as a fraction; least words of a sketch.
SHARE, SKETCH = (4, 5), 8
#: Documents of the sample that the order of shingles is taken from, in how many of them a shingle is common, and most common ones. Not part of the answer.
SAMPLE, COMMON, MOST_COMMON = 20_000, 3, 100_000
#: Shingles of a part: texts of a component of candidates are compared in parts of about this many.
PART = 1 << 15
#: Runs up to this length are compared by shifted copies of the sorted posts; longer ones by a search each.
SHORT_RUN = 24
#: Neighbours that a post of similar size is compared with; where there are more, the whole key goes on.
NEIGHBOURS = 256
#: Join keys among which the edges of one node are dealt.
SALTS = 32
#: Bytes that a round of an exchange may take for each shingle of all texts, and at least. What would take more goes in rounds, each ended before the next, so disk follows the input.
ROUND, LEAST_ROUND = 2, 1 << 28


def _hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, up to CHUNK at a time; without words nothing.

    bytes.lower and bytes.split know A-Z and \\t-\\r and space only.
    """
    words = text.lower().split()
    if not words:
        return
    spaced = b" ".join(words)
    h = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    for k in range(0, n, CHUNK):
        to = min(k + CHUNK, n)
        a, b = starts[k:to].tolist(), (ends[k + last : to + last] - 1).tolist()
        yield np.array([h(spaced[i:j], SEED) for i, j in zip(a, b, strict=True)], np.uint64)


def _majority(parts: Iterable[np.ndarray]) -> int:
    """Unsigned 64-bit fingerprint of shingles' hashes: the bits set in over half of them; of none zero."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big") if n else 0


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    return _distinct(_hashes(text, shingle))


def _distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def set_and_fingerprint(text: bytes, shingle: int = 5) -> tuple[np.ndarray, int]:
    """shingle_set and fingerprint, with one pass over the shingles."""
    parts = list(_hashes(text, shingle))
    return _distinct(parts), _majority(parts)


def set_class(own: np.ndarray) -> int:
    """A long that stands for a shingle set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of 64 * SKETCH parts, or of the least power of two that is half the set's size."""
    bits = max(64 * SKETCH, 1 << max(0, (len(own) + 1) // 2 - 1).bit_length())
    parts = (own % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(parts, minlength=bits) & 1).astype(bool)).view(np.uint64)


def prefix(own: np.ndarray, common_ones: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set, common ones (ascending, with how often) last."""
    n = len(own)
    if not n:
        return own
    rank = np.zeros(n, np.int64)
    if len(common_ones):
        at = np.minimum(np.searchsorted(common_ones, own), len(common_ones) - 1)
        rank = np.where(common_ones[at] == own, often[at], 0)
    return own[np.argsort(rank, kind="stable")[: n - -(-SHARE[0] * n // SHARE[1]) + 1]]


def may_meet(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """Which posts, sorted by key and size, may be the first shingle that their set shares with another of at least SHARE, of another group; whole runs of a key.

    A post of a set of x shingles with place (from 0) i has x - i left. Never false for the first common post of such sets.
    Without groups each post is one of its own.
    """
    num, den = SHARE
    out, i = np.zeros(len(keys), bool), np.arange(len(keys))
    groups = i if groups is None else groups
    if len(keys):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        mixed = np.minimum.reduceat(groups, first) != np.maximum.reduceat(groups, first)
        i = np.flatnonzero(np.repeat(mixed, np.diff(np.append(first, len(keys)))))
    for d in range(1, NEIGHBOURS):
        i = i[: np.searchsorted(i, len(keys) - d)]
        i = i[(keys[i] == keys[i + d]) & (den * sizes[i] >= num * sizes[i + d])]
        if not len(i):
            return out
        x, y = sizes[i], sizes[i + d]
        near = i[(groups[i] != groups[i + d]) & (-(-num * (x + y) // (num + den)) <= np.minimum(x - places[i], y - places[i + d]))]
        out[near] = out[near + d] = True
    return out | np.isin(keys, keys[i])


def distinct(edges: np.ndarray) -> np.ndarray:
    """Edges as rows, each once, the smaller end first."""
    return np.unique(np.sort(edges.reshape(-1, 2), axis=1), axis=0)


class Sketches:
    """Sketches of rows and their sets' sizes; each also folded to half its width, so that those of similar sizes compare."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray):
        self.sizes, self.width = sizes, np.array([len(x) // 8 for x in sketches])
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            rows, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            own = np.frombuffer(b"".join([sketches[i] for i in rows]), np.uint64).reshape(-1, w)
            wider = np.frombuffer(b"".join([sketches[i] for i in twice]), np.uint64).reshape(-1, 2 * w)
            at = np.full(len(sizes), -1)
            at[np.concatenate([rows, twice])] = np.arange(len(rows) + len(twice))
            self.levels[w] = at, np.concatenate([own, wider[:, :w] ^ wider[:, w:]])

    def may_share(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows may have SHARE of their shingles in common, by sizes and sketches; never false where they do."""
        num, den = SHARE
        x, y = self.sizes[a], self.sizes[b]
        least = -(-num * (x + y) // (num + den))
        out, limit = least <= np.minimum(x, y), x + y - 2 * least
        narrow = np.minimum(self.width[a], self.width[b])
        for w in np.unique(narrow[out]).tolist():
            at, rows = self.levels[w]
            for k in np.array_split(to := np.flatnonzero(out & (narrow == w)), 1 + len(to) * w // CHUNK):
                out[k] = np.bitwise_count(rows[at[a[k]]] ^ rows[at[b[k]]]).sum(axis=1, dtype=np.int64) <= limit[k]
        return out

    def forest(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """As forest, among some rows; edges are row numbers."""
        left, edges = rows, []
        while len(left) > 1:
            front, left = [int(left[0])], left[1:]
            while front and len(left):
                at = front.pop()
                near = self.may_share(np.full(len(left), at), left)
                if near.any():
                    edges += [(at, int(x)) for x in left[near]]
                    front += left[near].tolist()
                    left = left[~near]
        return edges

    def edges(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Distinct edges of ids, the smaller first, among posts that are sorted by key; whole runs of a key."""
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        long = size > SHORT_RUN
        out = [np.zeros((0, 2), np.int64)]
        for a, n in zip(first[long].tolist(), size[long].tolist(), strict=True):
            out.append(ids[np.array(self.forest(np.arange(a, a + n)), np.int64).reshape(-1, 2)])
        at = np.flatnonzero(np.repeat(~long, size))
        k = keys[at]
        for d in range(1, SHORT_RUN):
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            a, b = at[same], at[same + d]
            near = self.may_share(a, b)
            out.append(ids[np.stack([a[near], b[near]], axis=1)])
        return distinct(np.concatenate(out))


def shared_forest(sets: list[np.ndarray], joined: int = 0) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among shingle sets: SHARE of their shingles in common, counted. The first sets, as many as joined, are known to hang together."""
    num, den = SHARE
    sizes = np.array([len(x) for x in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marks, left, edges = np.zeros(len(values), bool), np.arange(joined, len(sets)), []

    def of(i: int) -> np.ndarray:
        return codes[ends[i] - sizes[i] : ends[i]]

    def gather() -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate([of(i) for i in left]), np.cumsum(sizes[left]) - sizes[left]) if len(left) else (codes[:0], left)

    front = list(range(joined))
    while len(left) > 0:
        if not front:
            front, left = [int(left[0])], left[1:]
        flat, starts = gather()
        while front and len(left):
            at = front.pop()
            marks[of(at)] = True
            both = np.add.reduceat(marks[flat], starts, dtype=np.int64)
            marks[of(at)] = False
            near = den * both >= num * (sizes[left] + sizes[at] - both)
            if near.any():
                edges += [(at, int(x)) for x in left[near]]
                front += left[near].tolist()
                left = left[~near]
                flat, starts = gather()
        front = []
    return edges


def share(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have SHARE of their shingles in common."""
    num, den = SHARE
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8; without words zero."""
    return _majority(_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.array([fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return common.map_batches(common.id_text(docs, id_col, text_col), f, "doc_id long, fp long")


def segment_counts(half: np.ndarray) -> np.ndarray:
    """Embedding of 32-bit halves: the bit counts of their 16 segments of two bits, in two bits each."""
    return half - ((half >> np.uint64(1)) & np.uint64(0x55555555))


def posts(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points (as keys: half in bit 32, then 16 counts) and the number of the fingerprint that posts each."""
    keys, owners = [], []
    own = np.arange(len(fps))
    for side in (0, 1):
        at = segment_counts((fps >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)) | np.uint64(side << 32)
        keys.append(at)
        owners.append(own)
        for k in range(16):
            one, here = np.uint64(1 << 2 * k), (at >> np.uint64(2 * k)) & np.uint64(3)
            for ok, to in ((here < 2, at + one), (here > 0, at - one)):
                keys.append(to[ok])
                owners.append(own[ok])
    return np.concatenate(keys), np.concatenate(owners)


def forest(fps: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fingerprints that share a grid point."""
    left, edges = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= most
            if near.any():
                found = left[near]
                edges += [(int(at), int(x)) for x in found]
                front += list(found)
                left = left[~near]
    return edges


def edges_of(keys: np.ndarray, fps: np.ndarray, most: int = MOST) -> set[tuple[int, int]]:
    """Edges among posts that are sorted by key; whole runs of a key."""
    out: set[tuple[int, int]] = set()
    if len(keys) < 2:
        return out
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    long = size > SHORT_RUN
    for a, n in zip(first[long].tolist(), size[long].tolist(), strict=True):
        out.update((min(e), max(e)) for e in forest(fps[a : a + n], most))
    short = np.repeat(~long, size)
    k, f = keys[short], fps[short]
    for d in range(1, SHORT_RUN):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        a, b = f[same], f[same + d]
        near = np.bitwise_count(a ^ b) <= most
        out.update(zip(np.minimum(a[near], b[near]).tolist(), np.maximum(a[near], b[near]).tolist(), strict=True))
    return out


def links(fps: DataFrame, most: int = MOST, tables: common.Passing | None = None) -> DataFrame:
    """Edges a < b among distinct fingerprints (column fp); their components are those of all links. tables: what holds them, if they are to be dropped."""
    if most > MOST:
        raise ValueError(f"the grid serves up to {MOST} bits")

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = batch.column(0).to_numpy().view(np.uint64)
        keys, owners = posts(f)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(f[owners].view(np.int64))], ["key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, seen = np.zeros(0, np.int64), np.zeros(0, np.uint64), set()

        def out(edges: set[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(sorted(edges), np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) and keys[-1] != keys[0] and len(keys) >= CHUNK:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key's run may go on
                seen |= edges_of(keys[:cut], fps[:cut], most)
                keys, fps = keys[cut:], fps[cut:]
                if len(seen) >= CHUNK:
                    yield out(seen)
                    seen = set()
        seen |= edges_of(keys, fps, most)
        if seen:
            yield out(seen)

    own = fps.select("fp").distinct()
    posted = common.map_batches(own, post, "key long, fp long")
    posted = posted.repartition(common.partitions_for(fps), "key").sortWithinPartitions("key")
    return (tables.written if tables else common.written)(common.map_partitions(posted, join, "a long, b long"), "simhash-edges").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that has an edge: root is the component's smallest node.

    Large star: the larger neighbours of a node go to its smallest neighbour. Small star: so do the smaller ones and the node.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        # a node of very many edges is SALTS keys of the join; a node meets only the salts that its edges have
        both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.collect_set("salt").alias("salts"))
        to = both.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"])
        if large:
            new = to.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            new = to.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(to.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return new.where("a < b").distinct()

    def sign(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    spark = edges.sparkSession
    e, at = common.written_at(edges.select("a", "b"), "cc")
    before = sign(e)
    while True:
        e, now_at = common.written_at(stars(stars(e, True), False), "cc")
        now = sign(e)
        common.drop_path(spark, at)
        at = now_at
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, a row for each row of docs."""
    own = common.written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = common.written(classes, "simhash-classes")
    roots = components(links(classes, most))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that the join reads a plain exchange, which adaptive execution splits where one component is most of the rows
    named = common.written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    named = common.written(rooted.join(named, "root").select("fp", "component_id"), "simhash-named")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that several documents of a sample hold, and in how many of it."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(docs.count(), 1))) < SAMPLE)
    found = common.map_batches(sample, f, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    at, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(at)
    return at[order], n[order]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that are sorted by their first column, joined to whole runs of it, CHUNK rows or more."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK and held[0].column(0)[0] != batch.column(0)[-1]:
            whole = pa.concat_batches(held)
            cut = int(np.searchsorted(whole.column(0).to_numpy(), whole.column(0)[-1].as_py()))
            yield whole.slice(0, cut)
            held, rows = [whole.slice(cut)], len(whole) - cut
    if held:
        yield pa.concat_batches(held)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, part: int = PART, tables: common.Passing | None = None) -> DataFrame:
    """doc_id, ta, tb (common.text_key of the text), component_id, stays: components of documents whose shingle sets have a Jaccard similarity of SHARE or more.

    stays marks, in each component, the row of the least id that is not null (of equal ids the least text key); rows that share id and text are all marked.
    tables: what holds intermediate tables; once it is dropped, the result can't be read.
    """
    tables = tables or common.Passing(docs.sparkSession)
    docs = common.id_text(docs, id_col, text_col)
    ordered = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    tables.ended()

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, fps = zip(*(set_and_fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()), strict=True)
        cols = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array([set_class(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64())]
        cols += [pa.array([sketch(x).tobytes() for x in own], pa.binary()), pa.array([prefix(x, *ordered.value).tobytes() for x in own], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *cols], ["doc_id", "ta", "tb", "simhash", "cls", "size", "fp", "prefix"])

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        n = [len(x) for x in keys]
        each = batch.select([0, 1, 2]).take(pa.array(np.repeat(np.arange(len(n)), n)))
        places = np.concatenate([np.arange(k) for k in n])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), each.column(0), each.column(1), pa.array(places), each.column(2)], ["key", "cls", "size", "place", "grp"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            same = np.diff(batch.column(0).to_numpy()) == 0
            batch = batch.filter(pa.array(np.append(same, False) | np.append(False, same)))
            keys, sizes, places = (batch.column(k).to_numpy() for k in (0, 2, 3))
            groups = pc.coalesce(batch.column(4), batch.column(1)).to_numpy()
            by = np.lexsort((sizes, keys))
            on = by[may_meet(keys[by], sizes[by], places[by], groups[by])]
            yield batch.select(["key", "cls", "size"]).take(pa.array(np.sort(on)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((0, 2), np.int64)
        for batch in runs(batches):
            if batch.num_rows:
                met_at = Sketches(batch.column(3).to_pylist(), batch.column(2).to_numpy())
                seen = distinct(np.concatenate([seen, met_at.edges(batch.column(0).to_numpy(), batch.column(1).to_numpy())]))
            if len(seen) >= CHUNK:
                yield edges_out(seen)
                seen = seen[:0]
        yield edges_out(seen)

    n = common.partitions_for(docs)
    keyed = docs.select("*", *(k.alias(c) for k, c in zip(common.text_key(F.col("text")), ("ta", "tb"), strict=True)))
    own = tables.written(common.map_batches(keyed, sets, "doc_id long, ta long, tb long, simhash long, cls long, size long, fp binary, prefix binary"), "near-sets")
    groups = simhash_groups(own, tables)
    tables.ended()
    several = own.groupBy("cls").count().where("count > 1").select("cls").unionByName(groups.select("cls")).distinct()
    several = common.holder(several)([F.col("cls")])
    prefixes = own.select("cls", "size", "prefix")  # few rows share their class or group, so only those are shuffled
    grouped_ones = prefixes.where(several).dropDuplicates(["cls"]).join(groups, "cls", "left")
    prefixes = prefixes.where(~several).withColumn("grp", F.lit(None).cast("long")).unionByName(grouped_ones)
    posted = common.map_batches(prefixes.select("cls", "size", "grp", "prefix"), post, "key long, cls long, size long, place long, grp long")
    posted = common.map_partitions(posted.repartition(n, "key").sortWithinPartitions("key"), met, "key long, cls long, size long")
    posted = tables.written(posted, "near-posts")
    tables.ended()
    sketches = own.select("cls", "fp").dropDuplicates(["cls"])
    budget = own.agg(F.sum("size")).first()[0]
    sketched = posted.agg(F.sum(F.greatest(F.lit(8 * SKETCH), F.col("size") / 8) + 24)).first()[0]
    rounds = rounds_for(sketched, budget)
    found = groups.where("grp < cls").select(F.col("grp").alias("a"), F.col("cls").alias("b"))
    for r in range(rounds):
        some = posted.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r).join(sketches, "cls").select("key", "cls", "size", "fp")
        met_at = common.map_partitions(some.repartition(n, "key").sortWithinPartitions("key"), candidates, "a long, b long")
        if rounds > 1:
            met_at = tables.written(met_at, f"near-candidates-{r}")
            tables.ended()
        found = found.unionByName(met_at)
    found = tables.written(found.distinct(), "near-candidates")
    own = tables.written(own.select("doc_id", "ta", "tb", "cls", "size"), "near-rows")
    tables.drop("near-sets", "near-posts", *(f"near-candidates-{r}" for r in range(rounds) if rounds > 1))
    classes = tables.written(own.groupBy("cls").agg(F.first("size").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ta", "tb")).alias("least")), "near-classes")
    edges = true_links(found, classes.select("cls", "size", "least.ta", "least.tb"), keyed.select("text", "ta", "tb"), shingle, part, tables, budget)
    roots = components(edges)
    rooted = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    # written, so that the join reads a plain exchange, which adaptive execution splits where one component is most of the rows
    named = tables.written(rooted.groupBy("root").agg(F.min("least").alias("stays")), "near-named-roots")
    named = tables.written(rooted.join(named, "root").select("cls", "stays"), "near-named")
    out = own.select("doc_id", "ta", "tb", "cls").join(named, "cls")
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("ta") == F.col("stays.ta")) & (F.col("tb") == F.col("stays.tb"))
    return out.select("doc_id", "ta", "tb", F.col("stays.doc_id").alias("component_id"), stays.alias("stays"))


def simhash_groups(own: DataFrame, tables: common.Passing) -> DataFrame:
    """cls, grp of every class whose fingerprint (column simhash) hangs together with another class's: grp is the least class of them.

    Texts with one shingle set may repeat its shingles differently; the least of their fingerprints counts.
    """
    fps = tables.written(own.groupBy("cls").agg(F.min("simhash").alias("fp")), "near-fps")
    roots = components(links(fps, tables=tables))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("cls", F.coalesce("root", "fp").alias("root"))
    # written, as in near_duplicates
    least = rooted.groupBy("root").agg(F.min("cls").alias("grp"), F.count("*").alias("n")).where("n > 1").select("root", "grp")
    return tables.written(rooted.join(tables.written(least, "near-least"), "root").select("cls", "grp"), "near-groups")


def rounds_for(total: float | None, shingles: int | None) -> int:
    """Rounds of an exchange of total bytes, where all texts have so many shingles."""
    return max(1, -(-int(total or 0) // max(LEAST_ROUND, ROUND * (shingles or 0))))


def edges_out(edges: np.ndarray) -> pa.RecordBatch:
    pairs = distinct(edges)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def forest_of(members: list[tuple[int, np.ndarray]], joined: int = 0) -> pa.RecordBatch:
    """Edges of classes by shared_forest of (class, set)."""
    found = np.array(shared_forest([x for _, x in members], joined), np.int64).reshape(-1, 2)
    return edges_out(np.array([c for c, _ in members], np.int64)[found])


def true_links(found: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, part: int, tables: common.Passing, shingles: int | None) -> DataFrame:
    """Edges a < b among classes of shingle sets, whose components are those of all links within components of candidates.

    found: candidate edges a, b. classes: cls, size, ta, tb (the key of a text of the class). texts: text, ta, tb.
    shingles: how many all texts have.
    """
    n = common.partitions_for(found)
    roots = components(found)
    roots = tables.written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "near-roots")  # a root itself has no row
    members = tables.written(roots.join(classes, F.col("node") == F.col("cls")).select("root", "cls", "size", "ta", "tb"), "near-of")
    texts = texts.where(common.holder(members.select("ta", "tb"))([F.col("ta"), F.col("tb")]))  # only theirs are shuffled, and few others
    some = members.join(texts, ["ta", "tb"], "inner").groupBy("root", "cls", "size", "ta", "tb").agg(F.first("text").alias("text"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(t, shingle).tobytes() for t in batch.column(3).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["root", "cls", "size", "own"])

    sets = tables.written(common.map_batches(some.select("root", "cls", "size", "text"), hashed, "root long, cls long, size long, own binary"), "near-members")
    tables.ended()
    ends = found.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("degree"))
    hubs = members.join(ends, "cls").groupBy("root").agg(F.sum("size").alias("total"), F.max(F.struct("degree", "cls"))["cls"].alias("hub"))
    hubs = tables.written(hubs.withColumn("parts", F.ceil(F.col("total") / part).cast("int")), "near-hubs")
    of = sets.join(hubs, "root")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 1):
            if len(group) > 1:
                yield forest_of([(c, np.frombuffer(own, np.uint64)) for _, c, own in group])

    small = of.where("parts = 1").select("root", "cls", "own").repartition(n, "root").sortWithinPartitions("root", "cls")
    edges = tables.written(common.map_partitions(small, together, "a long, b long"), "near-edges")
    large = hubs.where("parts > 1")
    if large.isEmpty():
        tables.drop("near-members")
        return edges

    def with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for root, p, member, c, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = np.frombuffer(own, np.uint64)
                if not member:
                    at, hub = (root, p), own
                elif at == (root, p):
                    out.append((root, c, share(hub, own)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)] if out else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())], ["root", "cls", "joined"])

    big = of.where("parts > 1").select("root", "cls", "own", "hub", "parts")
    dealt = big.where("cls <> hub").select("root", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), "cls", "own")
    sent = big.where("cls = hub").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), "cls", "own")
    met = dealt.unionByName(sent).repartition(n, "root", "part").sortWithinPartitions("root", "part", "member")
    joined = tables.written(common.map_partitions(met, with_hub, "root long, cls long, joined boolean"), "near-joined")
    star = joined.where("joined").join(large.select("root", "hub"), "root").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b"))
    open_ones = joined.where("not joined").select("root", "cls").join(classes.select("cls", "size"), "cls")
    open_parts = tables.written(open_ones.groupBy("root").agg(F.ceil(F.sum("size") / part).cast("int").alias("open_parts")), "near-open")

    def parts_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            once = {c: (joined, np.frombuffer(own, np.uint64)) for *_, joined, c, own in group}
            first = [(c, own) for c, (joined, own) in once.items() if joined]
            rest = [(c, own) for c, (joined, own) in once.items() if not joined]
            if rest and len(once) > 1:
                yield forest_of(first + rest, len(first))

    state = joined.select("cls", "joined")
    all_of = big.join(open_parts, "root").join(state, "cls", "left").select("root", "cls", "own", "parts", "open_parts", F.coalesce("joined", F.lit(True)).alias("joined"))
    of_part = lambda c: F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.col(c))).cast("int")
    across = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(c)) - 1))
    all_of = tables.written(all_of, "near-large")
    tables.drop("near-members")
    left = all_of.where("not joined").select("root", of_part("open_parts").alias("i"), across("parts").alias("j"), "joined", "cls", "own")
    right = all_of.select("root", across("open_parts").alias("i"), of_part("parts").alias("j"), "joined", "cls", "own")
    pairs = left.unionByName(right)
    # a set goes to each part of the other side: the one exchange that may grow with the square of a component
    sent = all_of.agg(F.sum((F.length("own") + 40) * (F.col("open_parts") + F.when(F.col("joined"), 0).otherwise(F.col("parts"))))).first()[0]
    rounds, crossed = rounds_for(sent, shingles), edges.unionByName(star)
    for r in range(rounds):
        some = pairs.where(F.pmod(F.xxhash64("root", "i", "j"), F.lit(rounds)) == r).repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")
        crossed = crossed.unionByName(tables.written(common.map_partitions(some, parts_meet, "a long, b long"), f"near-crossed-{r}"))
        tables.ended()
    tables.drop("near-large")
    return crossed.distinct()


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of batches that are sorted by their first columns, as many as keys, a group at a time."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != at:
                if held:
                    yield held
                at, held = row[:keys], []
            held.append(row)
    if held:
        yield held


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one row of each component of similar_groups, all columns as they are. Edge cases as there and in common.only."""
    tables = common.Passing(docs.sparkSession)
    decided = common.written(similar_groups(docs, id_col, text_col, shingle, tables=tables).select("doc_id", "ta", "tb", "stays"), "near-decided")
    tables.drop()
    return common.only(docs, [docs[common.quoted(id_col)].cast("long"), *common.text_key(docs[common.quoted(text_col)])], decided)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
