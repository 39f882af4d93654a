import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill.config import RunFilter
from glyphmill.operators import matching as M
from glyphmill.operators import reports as R
from glyphmill.operators.spatial import overlap_join
from glyphmill.plans.queries import QUERIES

GT = "sample_id long, pos int, x int, y int, w int, h int"
COMP = "sample_id long, id int, x int, y int, w int, h int, kind string"


def chars(spark, boxes, sid=1):
    return spark.createDataFrame([(sid, i, *b) for i, b in enumerate(boxes)], GT)


def comps(spark, boxes, sid=1):
    return spark.createDataFrame([(sid, i, *b[:4], b[4] if len(b) > 4 else "text") for i, b in enumerate(boxes)], COMP)


def metrics(spark, g, c, nontext=(), complete=True):
    samples = spark.createDataFrame([(1, complete)], "sample_id long, gt_complete boolean")
    f = M.char_metrics(comps(spark, c), chars(spark, g), chars(spark, nontext), samples)
    return f.select("*", *(v.alias("r_" + n) for n, v in M.char_rates().items())).first()


FIVE = [(20 * i, 50, 10, 20) for i in range(5)]


@pytest.mark.parametrize(
    ("g", "c", "expected"),
    [
        (FIVE, FIVE, {"isolated": 5, "merged": 0, "over_segmented": 0, "missed": 0, "junk": 0}),
        ([(0, 50, 10, 20), (10, 50, 10, 20)], [(0, 50, 20, 20)], {"merged": 2, "isolated": 0}),
        ([(0, 50, 10, 20)], [(0, 50, 10, 9), (0, 61, 10, 9)], {"over_segmented": 1}),
        ([(0, 50, 10, 20)], [(0, 50, 10, 20, "noise")], {"missed": 1, "n_surviving": 0}),
        ([(0, 50, 10, 20)], [(0, 50, 10, 20, "diacritic")], {"isolated": 1}),
        ([(0, 50, 10, 20)], [(0, 50, 10, 20), (400, 10, 12, 12)], {"junk": 1, "r_junk_rate": 0.5}),
        ([*FIVE, (200, 64, 4, 4)], FIVE, {"small_gt": 1, "small_retained": 0, "r_small_retention": 0.0}),
        (FIVE, FIVE, {"small_gt": 0, "r_small_retention": None}),
        ([], FIVE, {"n_gt": 0, "r_isolation_recall": 0.0, "junk": 0, "n_surviving": 5}),
        # cleanly matched, though another component covers it and its neighbours
        ([(0, 50, 10, 20), (10, 50, 10, 20), (20, 50, 10, 20)], [(0, 50, 10, 20), (0, 50, 30, 20)], {"isolated": 1, "merged": 2}),
    ],
)
def test_outcomes(spark, g, c, expected):
    r = metrics(spark, g, c)
    assert {k: r[k] for k in expected} == expected
    assert r.isolated + r.merged + r.over_segmented + r.missed == r.n_gt == len(g)


def test_junk_in_nontext_and_incomplete_truth(spark):
    r = metrics(spark, [(0, 50, 10, 20)], [(0, 50, 10, 20), (320, 20, 12, 12)], [(300, 0, 100, 100)])
    assert (r.junk, r.junk_in_nontext) == (1, 1)
    assert metrics(spark, [(0, 50, 10, 20)], [(400, 10, 12, 12)], complete=False).r_junk_rate is None


def regions(spark, words, lines, c):
    samples = spark.createDataFrame([(1,)], "sample_id long")
    f = M.word_metrics(comps(spark, c), chars(spark, words), chars(spark, lines), samples)
    return f.select("*", *(v.alias("r_" + n) for n, v in M.word_rates().items())).first()


@pytest.mark.parametrize(
    ("words", "lines", "c", "expected"),
    [
        ([(0, 50, 40, 20)], [], [(0, 50, 40, 20)], {"hit": 1, "r_mean_coverage": 1.0, "granularity": "word"}),
        ([], [(0, 50, 100, 20)], [(0, 50, 50, 20)], {"granularity": "line", "r_mean_coverage": 0.5}),
        ([(0, 50, 40, 20), (60, 50, 40, 20)], [], [(30, 50, 50, 20)], {"crossing": 2, "hit": 0, "junk": 0}),
        ([(0, 0, 100, 10)], [], [(0, 0, 60, 10), (40, 0, 60, 10)], {"r_mean_coverage": 1.0}),
        ([], [], [(0, 0, 5, 5)], {"granularity": "line", "n_gt": 0, "junk": 0}),
        ([(0, 0, 10, 10)], [], [(50, 50, 5, 5)], {"junk": 1, "hit": 0}),
    ],
)
def test_regions(spark, words, lines, c, expected):
    r = regions(spark, words, lines, c)
    assert {k: r[k] for k in expected} == expected


def test_union_area_is_exact(spark):
    rng = random.Random(1)
    found = [(rng.randrange(0, 40), rng.randrange(0, 30), rng.randrange(1, 15), rng.randrange(1, 12)) for _ in range(40)]
    r = M.word_coverage(comps(spark, found), chars(spark, [(5, 5, 30, 20)])).first()
    inside = [b for b in found if (max(0, min(b[0] + b[2], 35) - max(b[0], 5)) * max(0, min(b[1] + b[3], 25) - max(b[1], 5))) / (b[2] * b[3]) >= 0.5]
    cells = {(x, y) for a, b, w, h in inside for x in range(max(a, 5), min(a + w, 35)) for y in range(max(b, 5), min(b + h, 25))}
    assert r.covered == len(cells)


@pytest.mark.parametrize("cell", [8, 64, 1000])
def test_grid_join_is_the_nested_loop(spark, cell):
    boxes = [((37 * i) % 400, (53 * i) % 200, 1 + i % 40, 1 + (i * 7) % 30) for i in range(200)]
    a = chars(spark, boxes).toDF("sample_id", "i", "a_x", "a_y", "a_w", "a_h")
    b = chars(spark, boxes[::-1]).toDF("sample_id", "j", "b_x", "b_y", "b_w", "b_h")
    got = sorted((r.i, r.j, r.inter) for r in overlap_join(a, b, "sample_id", "a_", "b_", cell).collect())
    want = []
    for i, p in enumerate(boxes):
        for j, q in enumerate(boxes[::-1]):
            dx, dy = min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]), min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])
            if dx > 0 and dy > 0:
                want.append((i, j, dx * dy))
    assert got == sorted(want)


def facts(spark, rows):
    cols = "sample_id long, " + ", ".join(f"{c} long" for c in R.CHAR_COUNTERS) + ", gt_complete boolean"
    return spark.createDataFrame([(i, n, n, iso, 0, 0, n - iso, 0, 0, 0, 0, True) for i, n, iso in rows], cols)


def test_ratio_of_sums(spark):
    r = R.aggregate_chars(facts(spark, [(1, 1, 1), (2, 99, 0)])).select("n_gt", M.char_rates()["isolation_recall"].alias("r"), "gt_complete").first()
    assert tuple(r) == (100, 0.01, True)
    none = R.aggregate_chars(facts(spark, [(1, 1, 1)]).where("false")).first()
    assert (none.n_gt, none.gt_complete) == (0, False)


@pytest.mark.parametrize(("rows", "expected"), [([("word", 3), ("line", 2)], "mixed"), ([("word", 3), ("line", 0)], "word"), ([("line", 0)], "none")])
def test_granularity(spark, rows, expected):
    d = spark.createDataFrame([(g, n, 0, 0, 0, 0, 0.0) for g, n in rows], "granularity string, n_gt long, n_surviving long, hit long, crossing long, junk long, coverage_sum double")
    assert R.aggregate_words(d).first().granularity == expected


def test_percentiles(spark):
    r = R.percentiles(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v").first()
    assert (r.p50, r.p95, r.p99, r.max, r.n) == (50.5, 95.05, 99.01, 100.0, 100)
    assert R.percentiles(spark.range(0).select(F.col("id").cast("double").alias("v")), "v").count() == 0


def test_stage_medians(spark):
    rows = [(1, 0, "a", 1.0), (1, 0, "a", 2.0), (1, 1, "a", 5.0), (1, 2, "b", 4.0)]
    got = {r.stage: r.ms for r in R.stage_medians(spark.createDataFrame(rows, "document long, repeat int, stage string, ms double")).collect()}
    assert got == {"a": 3.0, "b": 0.0, "total": 4.0}


def test_run_plan(spark):
    s = spark.createDataFrame([(i, "u" if i % 2 else "v", "scan", "latin") for i in range(10)], "sample_id long, source string, capture string, script string")
    present, skipped = R.run_plan(s, s.where("sample_id > 3").select("sample_id"), RunFilter(sources=("u",), limit=2))
    assert [r.sample_id for r in present.collect()] == [5, 7] and sorted(r.sample_id for r in skipped.collect()) == [1, 3]


def test_markdown():
    assert R.pct(None) == "n/a" and R.pct(0.1234) == "12.3%"
    assert R.markdown_table(["a"], [[1]]) == "| a |\n|---|\n| 1 |"


#: Queries that join rows exploded from texts with other rows.
EXPLODED = ["aggregate_chars", "aggregate_words", "char_metrics", "char_outcomes", "char_pairs", "headline", "junk_components", "nested_form_words", "report_slices", "report_word_slices", "routing_by_capture", "small_retention", "word_coverage", "word_metrics", "manifest"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
@pytest.mark.parametrize("name", EXPLODED)
def test_no_exploded_rows_are_broadcast(spark, name):
    """By the plan, what is broadcast has at most a row a sample."""
    below = lambda p: [p, *(x for i in range(p.children().size()) for x in below(p.children().apply(i)))]
    for sent in below(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().initialPlan()):
        under = below(sent)[1:] if sent.nodeName() == "BroadcastExchange" else []
        if any(p.nodeName() == "Generate" for p in under):
            top = next(p for p in under if p.nodeName() not in ("Project", "Filter"))
            assert top.nodeName().endswith("Aggregate") and top.groupingExpressions().size() <= 1, sent.toString()[:2000]
