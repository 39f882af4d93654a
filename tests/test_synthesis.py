import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill import cli
from glyphmill.functions import capture as C
from glyphmill.functions import kernels as K
from glyphmill.functions import pages as P
from glyphmill.operators import annotations as A
from glyphmill.operators import raster, spatial, synth
from glyphmill.sources import store as S

TEMPLATES = [s[0] for s in synth.STRATA]


def profile(name):
    return C.Profile(name, *synth.PROFILES[name])


@pytest.mark.parametrize("template", TEMPLATES)
def test_pages_are_what_their_boxes_say(template):
    """Every character box holds ink to its edges, and no ink lies outside boxes."""
    page = P.page(template, random.Random(5))
    seen = np.zeros(page.image.shape, bool)
    for what, _, text, kind, x, y, w, h in page.boxes:
        part = page.image[y : y + h, x : x + w] < 255
        assert part.shape == (h, w)
        if what == "chars":
            assert part.any(axis=0)[[0, -1]].all() and part.any(axis=1)[[0, -1]].all()
        if what in ("chars", "regions_nontext"):
            seen[y : y + h, x : x + w] = True
    assert not ((page.image < 100) & ~seen).any()
    assert (P.page(template, random.Random(5)).image == page.image).all()
    with pytest.raises(ValueError):
        P.page("menu", random.Random(1))


@pytest.mark.parametrize("name", sorted(synth.PROFILES))
def test_boxes_follow_the_pixels(name):
    """Behind a capture the ink lies where the boxes are, and the same seed gives the same page."""
    image = np.full((300, 400), 255, np.uint8)
    boxes = [(40 + 60 * i, 60 + 50 * j, 30, 24) for i in range(5) for j in range(4)]
    for x, y, w, h in boxes:
        image[y : y + h, x : x + w] = 0
    out, moved, scale = C.degrade(image, boxes, profile(name), random.Random(9))
    again = C.degrade(image, boxes, profile(name), random.Random(9))
    assert (out == again[0]).all() and moved == again[1]
    assert out.shape == tuple(max(1, round(n * scale)) for n in image.shape)
    ground = np.median(out)
    for b in moved:
        if b is not None:
            x, y, w, h = b
            assert 0 <= x and 0 <= y and x + w <= out.shape[1] and y + h <= out.shape[0]
            assert out[y : y + h, x : x + w].mean() < 0.75 * ground
    assert sum(b is not None for b in moved) >= 15


def test_light_spans_its_range():
    for angle_seed in range(5):
        f = C.light(80, 60, 0.5, random.Random(angle_seed))
        assert f.shape == (60, 80) and 0.3 < f.min() and f.max() < 1.6
    flat = C.light(50, 50, 0.0, random.Random(1))
    assert np.allclose(flat, 1)


def test_homography_of_four_points():
    src, dst = np.array([[0, 0], [10, 0], [10, 8], [0, 8]], float), np.array([[1, 2], [12, 1], [11, 9], [-1, 8]], float)
    assert np.allclose(C.through(C.four_points(src, dst), src), dst)
    assert C.moved_box((0, 0, 10, 8), np.eye(3), 100, 100) == (0, 0, 10, 8)
    away = np.array([[1, 0, 95], [0, 1, 0], [0, 0, 1]], float)
    assert C.moved_box((0, 0, 10, 8), away, 100, 100) == (95, 0, 5, 8) and C.moved_box((2, 0, 10, 8), away, 100, 100) is None


def test_generated_store_is_evaluated(spark, tmp_path):
    """From a plan to a report; digital pages keep all their annotations."""
    tallies = cli.generate(spark, str(tmp_path), 6, 3)
    assert ("all", "all", 6, 6) in tallies and sum(n for t, _, n, _ in tallies if t == "template") == 6
    store = S.Store(spark, str(tmp_path))
    got = store.read().collect()
    assert len(got) == 6 and {r.sample_id for r in got} == {r.sample_id for r in store.images().collect()}
    assert all(r.chars and r.words and r.lines and r.meta["profile"] in synth.PROFILES for r in got)
    assert sorted(r.sample_id for r in synth.plan(spark, 6, 3).collect()) == sorted(r.sample_id for r in got)
    text = cli.evaluate(spark, str(tmp_path), cli.Settings.from_dict({"preprocess": {"upscale": False}}), cli.RunFilter(), repeats=1, warmup=0)
    assert "| character isolation recall | n/a |" not in text and "| total |" in text


def test_rows_depend_on_their_seed_alone(spark):
    plan = synth.plan(spark, 5, 11)
    a = {r.sample_id: (bytes(r.data), r.dpi) for r in synth.generate(plan).collect()}
    b = {r.sample_id: (bytes(r.data), r.dpi) for r in synth.generate(plan.repartition(1)).collect()}
    assert a == b


def test_debug_images_are_what_the_kernels_saw(spark):
    page = P.page("receipt", random.Random(1)).image
    d = spark.createDataFrame([("p", *page.shape, 1, bytearray(page.tobytes()))], "sample_id string, height int, width int, n_channels int, data binary")
    got = {r.stage: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in raster.debug_images(d).collect()}
    gray, _, _ = K.preprocess(page)
    assert (got["gray"] == gray).all() and (got["binary"] == K.binarize(gray)[0]).all()
    timed = raster.run_timed(d, repeats=2, warmup=1).collect()
    assert sorted((r.repeat, r.stage) for r in timed) == [(k, s) for k in range(2) for s in ("binarize", "ccl", "preprocess")] and all(r.ms > 0 for r in timed)


def test_cells_follow_the_boxes(spark):
    d = spark.createDataFrame([("a", 0, 0, 30, 10), ("a", 0, 0, 41, 5), ("a", 0, 0, 7, 90), ("b", 0, 0, 2, 3), ("c", 0, 0, None, None)], "page string, x int, y int, w int, h int")
    cells = spatial.cell_sizes(d, "page")
    assert {r.page: r.cell for r in cells.collect()} == {"a": 41, "b": 8, "c": 16}
    rng = random.Random(2)
    rows = [(rng.choice("abd"), i, rng.randrange(300), rng.randrange(300), rng.randint(1, 90), rng.randint(1, 90)) for i in range(120)]
    left, right = (spark.createDataFrame(rows, "page string, " + ", ".join(f"{p}{c} int" for c in ("id", "x", "y", "w", "h"))) for p in "ab")
    pairs = [sorted((r.aid, r.bid, r.inter) for r in spatial.overlap_join(left, right, "page", "a", "b", cells=c).collect()) for c in (None, cells)]
    brute = sorted((i, j, dx * dy) for p, i, x, y, w, h in rows for q, j, u, v, s, t in rows if p == q and (dx := min(x + w, u + s) - max(x, u)) > 0 and (dy := min(y + h, v + t) - max(y, v)) > 0)
    assert pairs == [brute, brute]


def test_paths_are_expanded(spark, tmp_path):
    for n in ("b.png", "a.png", "odd[1].png"):
        (tmp_path / n).write_bytes(b"")
    names = lambda *p: [x.rsplit("/", 1)[1] for x in S.expand(spark, [f"file://{tmp_path}/{q}" for q in p])]
    assert names("?.png") == ["a.png", "b.png"] and names("b.png", "a.png") == ["b.png", "a.png"] and names("odd[1].png") == ["odd[1].png"]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert names("*.jpg") == [] and any("no match" in str(w.message) for w in seen)


def test_one_review_a_sample(spark):
    """Of several proposals for a sample one counts, and the sample stays one row."""
    words = "array<struct<bbox:array<int>,text:string>>"
    s = spark.createDataFrame([("a", "user", "old", {}), ("b", "user", "old", {})], "sample_id string, source string, text string, meta map<string,string>").withColumn("words", A.no_boxes())
    w = [([1, 2, 3, 4], "one")]
    p = spark.createDataFrame([("a", "e", w), ("a", "e", [*w, ([5, 6, 7, 8], "two")]), ("x", "e", w), ("x", "e", w)], f"sample_id string, bootstrapped_with string, words {words}")
    out, unmatched = A.apply_reviews(s, p)
    assert sorted((r.sample_id, r.text) for r in out.collect()) == [("a", "one two"), ("b", "old")]
    assert [r.sample_id for r in unmatched.collect()] == ["x"]


def test_limit_takes_the_first_ids(spark):
    d = spark.range(20).select(F.format_string("s%02d", F.col("id")).alias("sample_id"))
    assert [r.sample_id for r in S.limited(d.repartition(4), 3).collect()] == ["s00", "s01", "s02"] and S.limited(d, None).count() == 20
