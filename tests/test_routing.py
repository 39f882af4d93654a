import pytest
from pyspark.sql import functions as F

from glyphmill.config import Route, Settings
from glyphmill.operators import routing as R

SCHEMA = "page int, id int, x int, y int, w int, h int, pixel_area int, fill_ratio double"


def page(spark, boxes, number=1):
    return spark.createDataFrame([(number, i, x, y, w, h, int(w * h * f), f) for i, (x, y, w, h, f) in enumerate(boxes)], SCHEMA)


def routed(spark, boxes, s=Route()):
    return {r.id: (r.kind, r.reason) for r in R.route(page(spark, boxes), s=s).collect()}


@pytest.mark.parametrize(
    ("w", "h", "fill", "expected"),
    [
        (10, 20, 0.5, ("text", "")), (1, 1, 1.0, ("noise", "t1:degenerate")), (800, 3, 0.95, ("rule", "t1:oversized_rule")), (3, 400, 0.9, ("rule", "t1:vertical_rule")), (700, 700, 0.02, ("rule", "t1:frame")),
        (700, 700, 0.85, ("blob", "t1:oversized")), (40, 30, 0.08, ("rule", "t1:hollow")), (200, 14, 0.25, ("text", "")), (200, 14, 0.05, ("text", "")), (90, 10, 0.9, ("text", "")), (200, 10, 0.9, ("rule", "t1:horizontal_rule")),
    ],
)
def test_absolute(spark, w, h, fill, expected):
    r = R.route_absolute(page(spark, [(10, 10, w, h, fill)])).first()
    assert (r.kind, r.reason) == expected


GLYPHS = [(15 * i, 100, 10, 20, 0.5) for i in range(20)]


def test_too_few_for_relative_gates(spark):
    out = R.route(page(spark, GLYPHS[:3])).collect()
    assert all(r.kind == "text" and not r.on for r in out)


def test_median(spark):
    s = R.filter_stats(R.route(page(spark, GLYPHS))).first()
    assert (s.median_height, s.relative_gates_applied, s.text, s.total, s.blob) == (20.0, True, 20, 20, 0)


@pytest.mark.parametrize(
    ("extra", "expected"),
    [
        ((500, 50, 60, 120, 0.6), ("blob", "t2:oversized_vs_median")), ((0, 92, 4, 4, 1.0), ("diacritic", "t2:diacritic")), ((0, 122, 4, 4, 1.0), ("diacritic", "t2:diacritic")),
        ((900, 900, 4, 4, 1.0), ("noise", "t2:small_orphan")), ((0, 20, 4, 4, 1.0), ("noise", "t2:small_orphan")),
    ],
)
def test_relative(spark, extra, expected):
    assert routed(spark, [*GLYPHS, extra])[20] == expected
    assert routed(spark, [*GLYPHS, extra], Route(relative=False))[20] == ("text", "")


def test_specks_do_not_move_the_scale(spark):
    specks = [(5 * i % 900, 500 + i, 2, 2, 1.0) for i in range(200)]
    d = page(spark, [*GLYPHS, *specks])
    assert R.weighted_median(d).first().median == 20
    assert d.agg(F.percentile("h", F.lit(0.5))).first()[0] == 2
    assert routed(spark, [*GLYPHS, *specks, (0, 20, 24, 40, 0.5)])[220] == ("text", "")


def test_picture_goes_first(spark):
    out = routed(spark, [*GLYPHS, (600, 300, 200, 250, 0.95)])
    assert out[20] == ("blob", "t2:dense_region") and out[0] == ("text", "")
    dense_stays = routed(spark, [*GLYPHS[:11], (600, 300, 200, 250, 0.95), (900, 900, 4, 4, 1.0)][:12])
    assert dense_stays[11] == ("blob", "t2:dense_region")


def test_pages_do_not_mix_and_partitioning_does_not_matter(spark):
    d = page(spark, [*GLYPHS, (0, 92, 4, 4, 1.0)], 1).unionByName(page(spark, [(0, 92, 4, 4, 1.0)], 2))
    a, b = (sorted(tuple(r) for r in R.route(x).select("page", "id", "kind", "reason").collect()) for x in (d, d.repartition(5)))
    assert a == b and (2, 0, "text", "") in a


def test_settings():
    s = Settings.from_dict({"route": {"least_text": 5}})
    assert s.route.least_text == 5 and s.preprocess == Settings().preprocess
    for bad in ({"route": {"nope": 1}}, {"nope": {}}):
        with pytest.raises(TypeError):
            Settings.from_dict(bad)
