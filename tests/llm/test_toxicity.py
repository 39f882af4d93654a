import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import toxicity as T

WORDS = "the of and river stone walk green lamp table house paper light north field".split()
BAD = {"en": ["stupid", "pathetic", "clown"], "xx": ["zorgal", "zorgen", "zorgit", "zorgum"]}


def corpus(n, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        toxic, words = int(rng.random() < 0.3), [rng.choice(WORDS) for _ in range(rng.randint(8, 40))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD[rng.choice(["en", "xx"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out(spark, docs):
    rows, labels = corpus(700)
    d, lab = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.score(d, T.train(d, lab)).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    assert 0.25 < len(held) / len(truth) < 0.42
    assert np.mean([got[i].predicted for i in held if truth[i]]) > 0.9
    assert np.mean([got[i].predicted for i in held if not truth[i]]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_held_out_labels_are_not_read(spark, docs):
    rows, labels = corpus(300)
    d = docs(rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = lab.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in T.score(d, T.train(d, x)).collect()) for x in (lab, flipped))
    assert a == b


def test_few_labels(spark, docs):
    lab = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs([(1, "you stupid clown"), (2, "a river"), (3, None)])
    got = {r.doc_id: r.predicted for r in T.score(d, T.train(d, lab)).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_edges(spark, edge_docs):
    model = T.train(edge_docs, edge_docs.sparkSession.createDataFrame([], "doc_id long, toxic int"))
    assert T.score(edge_docs, model).count() == edge_docs.count()
    kept = T.without_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert T.score(edge_docs.limit(0), model).count() == 0


def test_isotonic():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    knots, values = T.isotonic(x, np.array([0, 1, 0, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


def test_isotonic_against_least_squares():
    """The curve is the best monotone fit: no other of the block means that a search over all cuts finds is nearer."""
    rng = np.random.default_rng(2)
    x, y = np.sort(rng.normal(size=9)), rng.integers(0, 2, 9)
    s = np.concatenate([x, T.PSEUDO])
    order = np.argsort(s, kind="stable")
    t = np.concatenate([y, 1 / (1 + np.exp(-T.PSEUDO))])[order]
    w = np.concatenate([np.ones(9), np.full(len(T.PSEUDO), T.PSEUDO_WEIGHT)])[order]
    want = [max(min(np.average(t[i:j], weights=w[i:j]) for j in range(k + 1, len(t) + 1)) for i in range(k + 1)) for k in range(len(t))]  # the max-min formula
    knots, values = T.isotonic(x, y)
    assert np.allclose(np.interp(s[order], knots, values), want)


def test_trees_against_plain_boosting():
    """Scores equal those of a row-by-row walk of the trees, and training lowers the loss each round."""
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(200, len(T.NAMES))))
    y = (x[:, 7] + 0.3 * rng.normal(size=200) > 0.8).astype(float)
    trees = T.Trees().fit(x, y, rounds=12)

    def walk(row, upto):
        out = float(trees.prior(row[None])[0])
        for feat, cut, value in trees.trees[:upto]:
            node = 0
            while node < len(feat):
                b = sum(c <= row[feat[node]] for c in trees.cuts[feat[node]])
                node = 2 * node + 1 + (b > cut[node])
            out += value[node - len(feat)]
        return out

    assert np.allclose(trees.raw(x), [walk(r, 12) for r in x])
    loss = [np.mean(np.log1p(np.exp(-(2 * y - 1) * np.array([walk(r, n) for r in x])))) for n in (0, 4, 8, 12)]
    assert loss == sorted(loss, reverse=True)


def test_repeated_ids_train_once(spark, docs):
    d = docs([(2, "a river"), (2, "another stone"), (3, "you stupid clown"), (3, "you stupid clown")])
    lab = spark.createDataFrame([(2, 0, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert T.training_rows(d, lab, "doc_id", "text", 10).count() == len([i for i in (2, 3) if T.zlib.crc32(str(i).encode()) % 3 != 1])
