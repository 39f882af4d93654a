import random
from collections import Counter

import corpus_pipeline as C
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, exactdedup, mixing, simhash, toxicity
from glyphmill.llm import common as K

SHINGLE = 5


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def similar(a, b):
    return not a and not b or bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-12


def near_survivors(rows):
    """(id, text) of one row of each component of rows (id, text), by all pairs of whole shingle sets."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return groups.values()


def corpus(rng):
    words = [f"{a}{b}" for a in ("stone", "river", "lamp", "green", "walk") for b in range(60)]
    rows = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        if i % 4 == 0:
            text[3:3] = ["you", "stupid", "pathetic", "clown"]
        rows.append((i, " ".join(text), f"s{i % 5}"))
    rows += [(1000 + i, rows[i * 4 + 1][1].upper(), "s0") for i in range(20)]  # exact copies
    rows += [(2000 + i, rows[i * 4 + 2][1] + " one", "s1") for i in range(20)]  # near copies
    for i in range(60):  # copies with changed words, on both sides of the limit
        text = rows[i * 4 + 3][1].split()
        for k in rng.sample(range(len(text)), max(1, round(len(text) * rng.choice((0.01, 0.02, 0.03, 0.04))))):
            text[k] = "other"
        rows.append((4000 + i, " ".join(text), "s2"))
    return rows + [(3000, None, "s2"), (3001, "", None)]


def test_stages(spark, docs, tmp_path):
    rows = corpus(random.Random(1))
    d = docs(rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")

    step = {}
    for name, f in C.STAGES:
        out = f(spark, d, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        step[name] = d.collect()
        if name != "byte_bpe":
            assert d.columns == docs(rows).columns
    assert {r.doc_id for r in step["toxicity"]} == {i for i, *_ in rows if i >= 240 or i % 4}
    exact = {r.doc_id for r in step["exact_dedup"]}
    assert exact == {r.doc_id for r in step["toxicity"]} - {i * 4 + 1 for i in range(20)} - {3000}
    groups = near_survivors([(r.doc_id, r.text) for r in step["exact_dedup"]])
    assert {r.doc_id for r in step["near_dedup"]} == {min(g)[0] for g in groups} and sum(len(g) > 1 for g in groups) > 40
    again = mixing.mix(spark.read.parquet(f"{tmp_path}/near_dedup")).collect()
    assert sorted(r.doc_id for r in step["mixing"]) == sorted(r.doc_id for r in again for _ in range(r.copies))
    coder, texts = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), {r.doc_id: r.text or "" for r in step["mixing"]}
    assert sorted((r.doc_id, r.n_tokens) for r in step["byte_bpe"]) == sorted((r.doc_id, len(coder.ids(texts[r.doc_id])) // 4) for r in step["mixing"])
    assert C.run(spark, str(tmp_path)).count() == len(step["byte_bpe"])
    assert toxicity.THRESHOLD == 0.7


#: Names that helpers use, and columns that cannot be compared.
CLASHING = "doc_id long, text string, source string, _id long, _kept boolean, _maybe int, _size int, _n int, _copy int, _s int, row string, kept string, maybe string, k0 string, n long, rank double, plan string, extra map<string,int>"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, False, 1, 5, 9, 3, 2, f"r{k}", "k", "m", "z", 4, 0.5, "p", {"a": k}) for k, (i, t, s) in enumerate(rows)], CLASHING)


A, B = "a b c d e f g h i j", "q r s t u v w x y z"
AWKWARD = [(1, A, "s"), (1, B, "s"), (2, A, "t"), (2, A, "t"), (None, B + " one", None), (None, "lone words here", None), (3, None, "s"), (4, "", "s"), (5, B.upper(), "t"), (None, None, None), (6, "x" * 100_000, "t")]


def test_exact_stage_decides_by_row(spark):
    d = clashing(spark, AWKWARD)
    out = exactdedup.without_copies(d)
    assert out.columns == d.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    best = {}
    for i, t, _ in AWKWARD:
        key = (t or "").lower()
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    want = sorted(((None if i < 0 else i, t) for t, i in best.items()), key=repr)
    assert [(i, (t or "").lower()) for i, t in got] == [(i, t) for i, t in sorted(want, key=lambda x: repr((x[0], next(b for a, b in got if a == x[0] and (b or "").lower() == x[1]))))]
    assert exactdedup.without_copies(d.limit(0)).count() == 0


def test_near_stage_decides_by_row(spark):
    d = clashing(spark, AWKWARD)
    out = simhash.without_near_copies(d)
    assert out.columns == d.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    groups = near_survivors([(i, t) for i, t, _ in AWKWARD])
    assert len(got) == len(groups)
    for g in groups:
        ids = [i for i, _ in g if i is not None]
        kept = [x for x in got if x in g]
        assert len(kept) == 1 and kept[0][0] == (min(ids) if ids else None)
    assert simhash.without_near_copies(d.limit(0)).count() == 0


def test_mixing_stage_decides_by_row(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e f g", "s"), (None, "n o p", "s"), (None, "n o p", "s"), (None, "q r", None), (2, "", "s"), (3, None, "t")] + [(10 + i, "w " * (i % 7 + 1), "st"[i % 2]) for i in range(40)]
    rows += [(99, "same words", "t")] * 30
    d = clashing(spark, rows)
    out = mixing.mixed(d)
    assert out.columns == d.columns
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    texts = {}
    for i, t, s in rows:
        texts.setdefault((i, s, len((t or "").split())), set()).add(t)
    want = Counter()
    for r in mixing.mix(d).collect():
        assert len(of := texts[r.doc_id, r.source, r["size"]]) == 1
        want[r.doc_id, next(iter(of)), r.source] += r.copies
    assert got == +want and {r["_size"] for r in out.collect()} == {5}
    assert mixing.mixed(d.limit(0)).count() == 0


def test_toxicity_stage_keeps_columns(spark):
    d = clashing(spark, AWKWARD)
    model = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.without_toxic(d, model)
    assert out.columns == d.columns and out.count() == len(AWKWARD)
    assert toxicity.without_toxic(d.limit(0), model).count() == 0


def test_only_passes_keys_that_the_filter_cannot_tell(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_BITS", 1 << 12)
    d = spark.range(5000).withColumn("kept", F.col("id") % 3 != 0)
    out = K.only(d, [d["id"]], d.select("id", "kept"))
    assert {r.id for r in out.collect()} == {i for i in range(5000) if i % 3}


def test_scratch_needs_a_shared_folder():
    class Far:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        K.shared_dir(Far)
    Far.sparkContext.master = "local[4]"
    assert K.shared_dir(Far).startswith("file:")
    Far.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://x/y/")
    assert K.shared_dir(Far) == "hdfs://x/y"
