"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities and rates: of a fixed lexicon, of a lexicon learned from labelled texts (words and word beginnings that
toxic texts use far more often than others), of the distance between lexicon words and words for the reader, of capitals,
punctuation, repeated letters and obfuscated words.

Training reads a bounded sample: of the labelled rows whose crc32(doc_id as text) mod 3 is not 1, the MAX_TRAIN ids with the smallest hash.
The lexicon's counts are made on the cluster; features of a training row come from a lexicon learned without the row's fold,
and so do the scores that the isotonic curve is fitted to. Scoring covers every row in one pass without a shuffle.

Few labels are no special case. Trees start from a prior, the smoothed share of toxic rows raised by the density of the fixed lexicon, and
the isotonic curve is fitted to the rows and to PSEUDO weak ones that lie on the logistic curve. Labels outweigh both as they grow in number.

Edge cases. Null and empty texts: all features are zero, and they have a score. Null labels don't train. A row's label,
language, source and id never enter its score. Documents that share an id: the one whose text key is least trains, so MAX_TRAIN bounds rows; all are scored.
Repeated rows give repeated results; of repeated labels the larger counts. No labels: the prior alone. Ties of a score: kept together. Empty table: empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 20_000
FOLDS = 4
THRESHOLD = 0.7
#: The prior: log odds that a text gains by fixed lexicon words, and the share of words at which it has them all; rows that the share of toxic texts is smoothed by.
PRIOR, DENSE, SMOOTH = 4.0, 0.01, 10.0
#: Raw scores of the weak rows that the isotonic curve also fits, and the weight of each.
PSEUDO, PSEUDO_WEIGHT = np.arange(-8.0, 8.01, 0.5), 0.2
#: Word beginnings that the lexicon may learn, and how many entries it keeps.
PREFIXES, MOST_ENTRIES = (4, 5, 6), 4000
#: Common insults.
INSULTS = frozenset("idiot idiots moron stupid dumb loser losers scum trash worthless pathetic disgusting clown freak jerk imbecile filth vermin garbage creep ugly fool hate shut idiota imbécil estúpido basura asqueroso payaso escoria inútil dummkopf abschaum müll wertlos erbärmlich widerlich trottel versager hässlich crétin ordure minable dégoûtant racaille débile".split())
#: Words for the reader.
READER = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
SPLIT = re.compile(r"[\s.,;:!?|()\[\]\"]+")
LEET = str.maketrans("013457@$!*", "oieastasi*")
NAMES = ("fixed", "fixed_n", "learned", "learned_n", "learned_max", "learned_sum", "near", "capitals", "shouted", "punct", "bang", "repeats", "hidden", "length", "mean_word")


@dataclass
class Lexicon:
    """Weights (log odds) of words and of word beginnings."""

    words: dict[str, float] = field(default_factory=dict)

    def of(self, word: str) -> float:
        get = self.words.get
        best = get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n and (w := get(word[:n] + "*", 0.0)) > best:
                best = w
        return best


def words_of(text: str) -> list[str]:
    return [w for w in SPLIT.split(text.lower()) if w]


def keys_of(text: str) -> set[str]:
    """What a text may teach the lexicon: its words and their beginnings."""
    out = set(words_of(text))
    return out | {w[:n] + "*" for w in out for n in PREFIXES if len(w) > n}


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = words_of(text)
    n = max(len(words), 1)
    memo: dict[str, float] = {}
    hits, readers, weights, fixed, hidden = [], [], [], 0, 0
    for i, w in enumerate(words):
        x = memo.get(w)
        if x is None:
            plain = w if w.isalpha() else w.translate(LEET).replace("*", "").replace("-", "").replace("_", "")
            x = lexicon.of(w)
            if w in INSULTS:
                x += 100.0
            elif plain != w and plain in INSULTS:
                x += 1000.0
            if w in READER:
                x += 10000.0
            memo[w] = x
        if x:
            if x >= 10000.0:
                readers.append(i)
                x -= 10000.0
            if x >= 1000.0:
                hidden += 1
                x -= 1000.0
            elif x >= 100.0:
                fixed += 1
                x -= 100.0
                hits.append(i)
            if x:
                weights.append(x)
                hits.append(i)
    near = 0.0
    if hits and readers:
        r, h = np.array(readers), np.array(hits)
        at = np.clip(np.searchsorted(r, h), 1, len(r)) - 1
        gap = np.minimum(np.abs(h - r[at]), np.abs(h - r[np.minimum(at + 1, len(r) - 1)]))
        near = float((1.0 / (1.0 + gap)).sum()) / n
    size = max(len(text), 1)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    bangs = text.count("!")
    punct = bangs + text.count("?") + text.count("*") + text.count("#") + text.count("$")
    return [
        fixed / n, float(min(fixed, 20)), len(weights) / n, float(min(len(weights), 20)), max(weights, default=0.0), float(min(sum(weights), 100.0)), near,
        upper / size, float(upper > 0.5 * size), punct / size, bangs / size, float(len(words) - len(memo)) / n, hidden / n, float(np.log1p(len(words))), size / n,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth on binned features, log loss; arrays are complete binary trees."""

    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def prior(self, x: np.ndarray) -> np.ndarray:
        """Log odds before the first tree: of the share of toxic rows, and of fixed lexicon words, plain or hidden."""
        return self.base + PRIOR * np.minimum(1.0, (x[:, NAMES.index("fixed")] + x[:, NAMES.index("hidden")]) / DENSE)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) if len(np.unique(c)) > 33 else np.unique(c)[1:] for c in x.T]
        self.cuts = [c if len(c) else np.array([np.inf]) for c in self.cuts]
        b, width = self.bins(x), max(len(c) for c in self.cuts) + 1
        p = (y.sum() + 1.0) / (len(y) + SMOOTH)
        self.base = float(np.log(p / (1 - p)))
        score = self.prior(x)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            feat, cut, node = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, 1 << 30, np.int32), np.zeros(len(y), np.int64)
            for level in range(depth):
                first = 2**level - 1
                for k in range(first, first + 2**level):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2:
                        continue
                    gt, ht, best = g[rows].sum(), h[rows].sum(), 1e-9
                    for j in range(x.shape[1]):
                        gs = np.cumsum(np.bincount(b[rows, j], g[rows], width))
                        hs = np.cumsum(np.bincount(b[rows, j], h[rows], width))
                        ok = (hs >= least * 0.05) & (ht - hs >= least * 0.05)
                        gain = np.where(ok, gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge), 0)
                        i = int(np.argmax(gain))
                        if gain[i] > best:
                            best, feat[k], cut[k] = gain[i], j, i
                node = 2 * node + 1 + (b[np.arange(len(y)), feat[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
            self.trees.append((feat, cut, value))
            score += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), self.prior(x)
        rows = np.arange(len(x))
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (b[rows, feat[node]] > cut[node])
            out += value[node - (len(value) - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: score knots and calibrated values, fitted to the rows and to weak rows on the logistic curve."""
    s = np.concatenate([score, PSEUDO])
    t = np.concatenate([y.astype(float), PSEUDO_WEIGHT / (1 + np.exp(-PSEUDO))])
    w = np.concatenate([np.ones(len(y)), np.full(len(PSEUDO), PSEUDO_WEIGHT)])
    uniq, inverse = np.unique(s, return_inverse=True)
    blocks: list[list[float]] = []  # low, high, sum, weight
    for knot, a, c in zip(uniq, np.bincount(inverse, t), np.bincount(inverse, w), strict=True):
        blocks.append([knot, knot, a, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, _, a, c = blocks.pop(-2)
            blocks[-1] = [low, blocks[-1][1], blocks[-1][2] + a, blocks[-1][3] + c]
    knots = np.array([k for low, high, *_ in blocks for k in (low, high)])
    return knots, np.repeat([a / c for *_, a, c in blocks], 2)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.lexicon) for t in texts], float)
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.values), 0.0, 1.0)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int) -> DataFrame:
    """text, y, fold of the bounded sample, written. The sample's ids are at most max_train, so they are broadcast."""
    ids = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    ids = ids.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    ids = common.written(ids, "tox-ids")
    found = common.id_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    rows = found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(*common.text_key(F.col("text")))).alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")
    return common.written(rows.select("text", "y", fold.alias("fold")), "tox-train")


def learned(rows: DataFrame, sizes: dict[tuple[int, int], int]) -> list[Lexicon]:
    """A lexicon without each fold, and last one of all rows. sizes: rows by (fold, label)."""

    def count(batches):
        at: dict[str, int] = {}
        counts = np.zeros((1 << 12, 2 * FOLDS), np.int32)
        for batch in batches:
            for text, y, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [at.setdefault(key, len(at)) for key in keys_of(text.as_py())]
                if len(at) > len(counts):
                    counts = np.concatenate([counts, np.zeros((max(len(counts), len(at) - len(counts)), 2 * FOLDS), np.int32)])
                counts[own, 2 * fold + y] += 1
        # negatives of a key that no toxic row here has are still needed where another task has one
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), *(pa.array(counts[: len(at), c]) for c in range(2 * FOLDS))], ["key", *(f"c{c}" for c in range(2 * FOLDS))])

    schema = "key string, " + ", ".join(f"c{c} int" for c in range(2 * FOLDS))
    sums = common.map_partitions(rows, count, schema).groupBy("key").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(2 * FOLDS)))
    pos = sum((F.col(f"c{2 * f + 1}") for f in range(FOLDS)), F.lit(0))
    neg = sum((F.col(f"c{2 * f}") for f in range(FOLDS)), F.lit(0))
    all_pos, all_neg = (sum(v for (_, y), v in sizes.items() if y == k) for k in (1, 0))
    odds = ((pos + 0.1) / (all_pos + 1)) / ((neg + 0.1) / (all_neg + 1))
    kept = sums.where((pos >= 3) & (odds >= 8)).orderBy((pos * F.log(odds)).desc(), "key").limit(MOST_ENTRIES).collect()
    out = []
    for without in (*range(FOLDS), None):
        p_all = sum(v for (f, y), v in sizes.items() if y == 1 and f != without)
        n_all = sum(v for (f, y), v in sizes.items() if y == 0 and f != without)
        words = {}
        for r in kept:
            p = sum(r[f"c{2 * f + 1}"] for f in range(FOLDS) if f != without)
            n = sum(r[f"c{2 * f}"] for f in range(FOLDS) if f != without)
            w = float(np.log(((p + 0.1) / (p_all + 1)) / ((n + 0.1) / (n_all + 1))))
            if p >= 3 and w >= 2.0:
                words[r["key"]] = w * (1 - 1 / (p + 1))
        out.append(Lexicon(words))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    rows = training_rows(docs, labels, id_col, text_col, max_train)
    sizes = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    lexicons = learned(rows, sizes)
    held = rows.sparkSession.sparkContext.broadcast(lexicons)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        fold = batch.column(2).to_pylist()
        x = np.array([features(t.as_py(), held.value[k]) for t, k in zip(batch.column(0), fold, strict=True)], float)
        return pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "fold"])

    # at most max_train rows of few numbers
    got = common.map_batches(rows, f, "x array<double>, y int, fold int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    y, fold = got.column("y").to_numpy().astype(float), got.column("fold").to_numpy()
    order = np.lexsort((*x.T[::-1], y, fold))
    x, y, fold = x[order], y[order], fold[order]
    out = np.zeros(len(y))
    for k in np.unique(fold):
        rest = fold != k
        out[~rest] = Trees().fit(x[rest], y[rest]).raw(x[~rest])
    return Model(lexicons[-1], Trees().fit(x, y), *isotonic(out, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = held.value.scores(batch.column(1).to_pylist())
        out = [None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return common.map_batches(common.id_text(docs, id_col, text_col), f, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are. Null texts count as empty; equal rows are judged alike."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(held.value.scores(batch.column(at).fill_null("").to_pylist()) < threshold))

    return common.map_batches(docs, f, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
