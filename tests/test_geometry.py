from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill.config import Preprocess
from glyphmill.functions import geometry as G
from glyphmill.functions.geometry import Box


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def box(x, y, w, h):
    return Box(*(F.lit(v) for v in (x, y, w, h)))


def values(spark, b):
    return tuple(one(spark, *b.columns()))


def test_overlap(spark):
    A, B = box(0, 0, 10, 10), box(5, 0, 10, 10)
    r = one(spark, G.intersection(A, B), G.iou(A, B), G.coverage_of(A, B), G.vertical_overlap(A, B), G.intersection(A, box(100, 100, 5, 5)), G.iou(A, box(100, 100, 5, 5)))
    assert tuple(r) == (50, 50 / 150, 0.5, 1.0, 0, 0.0)
    assert values(spark, G.union(A, B)) == (0, 0, 15, 10)


def test_points_and_scaling(spark):
    assert values(spark, G.from_points(F.array(F.lit(3), F.lit(11), F.lit(9)), F.array(F.lit(7), F.lit(2), F.lit(20)))) == (3, 2, 8, 18)
    assert values(spark, G.scaled(box(10, 10, 1, 1), F.lit(0.01))) == (0, 0, 1, 1)
    assert values(spark, G.scaled(box(5, 7, 5, 3), F.lit(0.5))) == (2, 4, 2, 2)  # half to even


@pytest.mark.parametrize(("h", "w", "cap", "least", "up", "scale"), [(500, 2000, 1000, 900, False, 0.5), (200, 500, 1600, 1000, True, 2.0), (900, 1200, 1600, 1000, True, 1.0)])
def test_scale(spark, h, w, cap, least, up, scale):
    s = Preprocess(max_side=cap, min_side=least, upscale=up)
    assert one(spark, G.compute_scale(F.lit(h), F.lit(w), s))[0] == scale


def test_rates_of_nothing(spark):
    assert tuple(one(spark, G.ratio(F.lit(1), F.lit(0)), box(0, 0, 5, 0).aspect)) == (0.0, 0.0)


def test_corners(spark):
    c = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    r = one(spark, G.from_corners(c(1.5, 2.5, 9, 9)), G.from_corners(c(1.9, 2, 9, 9), truncate=True), G.from_corners(c(5, 5, 5, 9)), G.from_corners(c(1, 2, 3)))
    assert tuple(r) == ([2, 2, 7, 7], [1, 2, 8, 7], None, None)


@pytest.mark.parametrize(("m", "expected"), [([1, 0, 0, 0, 1, 0, 0, 0, 1], (100, 100, 40, 20)), ([0.5, 0, 0, 0, 0.5, 0, 0, 0, 1], (50, 50, 20, 10)), ([1, 0, 10000, 0, 1, 0, 0, 0, 1], None)])
def test_homography(spark, m, expected):
    r = one(spark, G.homography_box(box(100, 100, 40, 20), [F.lit(float(v)) for v in m], F.lit(1000), F.lit(1000)))[0]
    assert (tuple(r) if r else None) == expected


def test_buckets_and_kernels(spark):
    assert [one(spark, G.dpi_bucket(F.lit(d)))[0] for d in (0, 99, 100, 149, 150, 249, 250)] == ["<100", "<100", "100-149", "100-149", "150-249", "150-249", ">=250"]
    assert [one(spark, G.kernel_size(F.lit(n)))[0] for n in (10, 1600, 1650, 3000)] == [31, 33, 33, 61]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
@pytest.mark.parametrize("name, part, most", [("homography_boxes", "5.0E-5", 16), ("zipped_boxes", "0.5 * cast", 16), ("field_boxes", "% 200", 6)])
def test_boxes_are_worked_out_once(spark, name, part, most):
    """A corner's expression stands in the plan once for each of a box's ends, not again for each use and filter."""
    from glyphmill.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(part) <= most, plan.count(part)
