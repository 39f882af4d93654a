"""One query for each operator, on relations derived from whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Binarize, Preprocess, RunFilter, Settings
from ..functions import geometry as G
from ..functions import kernels as K
from ..functions import text as X
from ..functions.geometry import Box
from ..operators import annotations as A
from ..operators import matching, raster, reports, routing, synth
from ..operators.spatial import spread
from . import derive as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return D.boxes(spark, sf)


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route(D.boxes(spark, sf))


# geometry ----------------------------------------------------------------------------------------------------------


@query
def tier1_routing(spark, sf):
    return routing.route_absolute(_boxes(spark, sf)).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query
def kind_counts(spark, sf):
    return routing.kind_counts(routing.route_absolute(_boxes(spark, sf)))


@query
def bbox_props(spark, sf):
    b = Box.of()
    return _boxes(spark, sf).select("page", "id", b.x2.alias("x2"), b.y2.alias("y2"), b.area.alias("area"), b.cx.alias("cx"), b.cy.alias("cy"), b.aspect.alias("aspect"), "fill_ratio")


def _neighbours(spark, sf):
    order = W.partitionBy("page").orderBy("id")
    return _boxes(spark, sf).select("page", "id", *Box.of().columns("a_"), *(F.lead(c).over(order).alias(f"b_{c}") for c in "xywh")).where("b_x is not null")


@query
def bbox_iou_pairs(spark, sf):
    a, b = Box.of("a_"), Box.of("b_")
    return _neighbours(spark, sf).select("page", "id", G.intersection(a, b).alias("inter"), G.iou(a, b).alias("iou"), G.coverage_of(a, b).alias("coverage"), G.vertical_overlap(a, b).alias("v_overlap"))


@query
def bbox_scaled(spark, sf):
    s = G.scaled(Box.of(), F.lit(0.25))
    return _boxes(spark, sf).select("page", "id", *s.columns())


@query
def bbox_union(spark, sf):
    return _boxes(spark, sf).groupBy("page").agg(*G.union_of())


@query
def bbox_pair_union(spark, sf):
    return _neighbours(spark, sf).select("page", "id", *G.union(Box.of("a_"), Box.of("b_")).columns())


@query
def polygon_to_bbox(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    pts = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("k") * a + F.col("c") * b + i * 37) % 400) / F.lit(2.0))
    return o.select("o_orderkey", *G.from_points(pts(7, 3), pts(5, 11)).columns())


def _dims(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", (50 + F.col("o_orderkey") * 31 % 3000).cast("int").alias("h"), (40 + F.col("o_custkey") * 17 % 3000).cast("int").alias("w"))


@query
def compute_scale(spark, sf):
    d = _dims(spark, sf).withColumn("scale", G.compute_scale(F.col("h"), F.col("w"), Preprocess()))
    return d.select("o_orderkey", "scale", G.resized(F.col("h"), F.col("scale")).alias("new_h"), G.resized(F.col("w"), F.col("scale")).alias("new_w"), G.interpolation(F.col("scale")).alias("interpolation"))


@query
def kernel_size(spark, sf):
    return _dims(spark, sf).select("o_orderkey", G.kernel_size(F.greatest("h", "w")).alias("kernel"))


@query
def dpi_bucket(spark, sf):
    return D.samples(spark, sf).groupBy(G.dpi_bucket(F.col("dpi")).alias("bucket")).agg(F.count("*").alias("n"))


@query
def effective_dpi(spark, sf):
    return D.samples(spark, sf).select("sample_id", G.effective_dpi(F.col("dpi"), F.lit(0.3) + (F.col("sample_id") % 7) * F.lit(0.1)).alias("dpi"))


@query
def cell_size(spark, sf):
    from ..operators.spatial import cell_sizes

    return cell_sizes(_boxes(spark, sf), "page")


@query
def xyxy_to_xywh(spark, sf):
    o = D.table(spark, sf, "orders")
    half = lambda e: (e / F.lit(2.0)).cast("double")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    corners = F.array(half(k % 300), half(c % 200), half((k * 7 + c) % 500), half((c * 3 + k) % 400))
    d = o.select("o_orderkey", G.from_corners(corners).alias("b"), G.from_corners(corners, truncate=True).alias("t"))
    return d.select("o_orderkey", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate("xywh")), *(F.get("t", F.lit(i)).alias("t" + n) for i, n in enumerate("xywh")))


# routing -----------------------------------------------------------------------------------------------------------


@query
def ink_weighted_median(spark, sf):
    text = routing.route_absolute(_boxes(spark, sf)).where("kind = 'text'")
    return routing.weighted_median(text)


@query
def diacritic_parent(spark, sf):
    from ..config import Route

    s = Route()
    live = routing.scaled_pages(routing.route_absolute(_boxes(spark, sf)), 1_000_000, s).where("on and kind = 'text' and not dense")
    return routing.with_parent(live.where(F.col("h") < s.under_median * F.col("median")), live.where(F.col("h") >= s.normal_median * F.col("median")), s)


@query
def tier2_routing(spark, sf):
    return _routed(spark, sf).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query
def filter_stats(spark, sf):
    return routing.filter_stats(_routed(spark, sf))


# latency -----------------------------------------------------------------------------------------------------------


@query
def percentiles(spark, sf):
    return reports.percentiles(D.timings(spark, sf), "ms", "stage")


@query
def stage_totals(spark, sf):
    return reports.stage_totals(D.timings(spark, sf)).select("document", "repeat", "stage", F.round("ms", 6).alias("ms"))


@query
def stage_medians(spark, sf):
    return reports.stage_medians(D.timings(spark, sf)).select("document", "stage", F.round("ms", 6).alias("ms"))


@query
def latency_summary(spark, sf):
    return reports.latency_summary(D.timings(spark, sf))


# matching ----------------------------------------------------------------------------------------------------------


@query
def char_pairs(spark, sf):
    p = matching.char_pairs(D.components(spark, sf), D.chars(spark, sf))
    return p.groupBy("sample_id").agg(F.count("*").alias("pairs"), F.sum("inter").alias("inter"), F.count_if(F.col("iou") >= 0.5).alias("matches"), F.count_if(F.col("of_gt") >= 0.5).alias("covers"), F.count_if(F.col("of_comp") >= 0.5).alias("fragments"))


@query
def char_outcomes(spark, sf):
    return matching.char_outcomes(D.components(spark, sf), D.chars(spark, sf))


@query
def junk_components(spark, sf):
    return matching.component_junk(D.components(spark, sf), D.chars(spark, sf), D.nontext(spark, sf)).where("junk").select("sample_id", "cid", "in_nontext")


@query
def small_retention(spark, sf):
    o = matching.char_outcomes(D.components(spark, sf), D.chars(spark, sf))
    return o.where("small").groupBy("sample_id").agg(F.count("*").alias("small_gt"), F.count_if((F.col("outcome") != "missed") | F.col("touched")).alias("small_retained"))


def _char_facts(spark, sf):
    return matching.char_metrics(D.components(spark, sf), D.chars(spark, sf), D.nontext(spark, sf), D.samples(spark, sf))


def _word_facts(spark, sf):
    return matching.word_metrics(D.components(spark, sf), D.gt_words(spark, sf), D.lines(spark, sf), D.samples(spark, sf))


@query
def char_metrics(spark, sf):
    return _char_facts(spark, sf)


@query
def word_metrics(spark, sf):
    f = _word_facts(spark, sf)
    return f.withColumn("coverage_sum", F.round("coverage_sum", 6))


@query
def word_coverage(spark, sf):
    return matching.word_coverage(D.components(spark, sf), D.words(spark, sf))


# reports -----------------------------------------------------------------------------------------------------------


@query
def aggregate_chars(spark, sf):
    f = _char_facts(spark, sf).join(D.samples(spark, sf).select("sample_id", "source"), "sample_id")
    d = reports.aggregate_chars(f, "source")
    return d.select("source", "samples", *reports.CHAR_COUNTERS, "gt_complete", *(F.round(c, 6).alias(n) for n, c in matching.char_rates().items()))


@query
def aggregate_words(spark, sf):
    f = _word_facts(spark, sf).join(D.samples(spark, sf).select("sample_id", "source"), "sample_id")
    return reports.aggregate_words(f, "source").withColumn("coverage_sum", F.round("coverage_sum", 4))


@query
def report_slices(spark, sf):
    return reports.char_slices(_char_facts(spark, sf), D.samples(spark, sf))


@query
def report_word_slices(spark, sf):
    return reports.word_slices(_word_facts(spark, sf), D.samples(spark, sf))


@query
def routing_by_capture(spark, sf):
    return reports.routing_by_capture(D.components(spark, sf), D.samples(spark, sf))


@query
def headline(spark, sf):
    c = reports.aggregate_chars(_char_facts(spark, sf)).select(*(F.round(v, 6).alias(n) for n, v in matching.char_rates().items()))
    w = reports.aggregate_words(_word_facts(spark, sf)).select(*(F.round(v, 6).alias("region_" + n) for n, v in matching.word_rates().items()))
    t = reports.latency_summary(D.timings(spark, sf)).where("stage = 'total'").select("p50", "p95", "p99")
    return c.join(F.broadcast(w)).join(F.broadcast(t))  # one row each


def _pictures(spark, sf):
    return D.samples(spark, sf).where("has_image").select("sample_id")


RUN = RunFilter(sources=("user", "assistant"), captures=("scan", "photo"), scripts=("latin",))


@query
def run_filter(spark, sf):
    return reports.matching_samples(D.samples(spark, sf), RUN).select("sample_id", "source", "capture", "script")


@query
def skipped_samples(spark, sf):
    return reports.run_plan(D.samples(spark, sf), _pictures(spark, sf), RUN)[1].select("sample_id")


@query
def run_limit(spark, sf):
    """The limit is the feature: so many processed samples."""
    return reports.run_plan(D.samples(spark, sf), _pictures(spark, sf), RunFilter(captures=("scan",), limit=25))[0].select("sample_id")


# annotations -------------------------------------------------------------------------------------------------------


def _sample_rows(spark, sf):
    """Samples in the nested schema, with words and, where annotated, characters."""
    b = lambda df, extra: df.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.array("x", "y", "w", "h").alias("bbox"), *extra))).alias("a"))
    w = b(D.gt_words(spark, sf), ["text"]).select(F.col("sample_id").alias("_w"), F.transform("a", lambda g: A.gt_box(g["bbox"], g["text"])).alias("words"))
    c = b(D.chars(spark, sf).where("sample_id % 3 = 0"), ["ch"]).select(F.col("sample_id").alias("_c"), F.transform("a", lambda g: F.struct(g["bbox"].alias("bbox"), g["ch"].alias("char"))).alias("chars"))
    d = D.samples(spark, sf).join(spread(w), F.col("sample_id") == F.col("_w"), "left").join(spread(c), F.col("sample_id") == F.col("_c"), "left")
    return d.select(F.col("sample_id").cast("string").alias("sample_id"), "source", "capture", "script", "dpi", "text", A.no_boxes().alias("lines"), F.coalesce("words", A.no_boxes()).alias("words"), "chars", A.no_boxes().alias("pii"), A.no_boxes().alias("regions_nontext"), F.create_map(F.lit("template"), F.col("template")).alias("meta"))


@query
def manifest(spark, sf):
    return A.manifest(_sample_rows(spark, sf), _pictures(spark, sf).select(F.col("sample_id").cast("string").alias("sample_id")))


@query
def source_status(spark, sf):
    counts = D.samples(spark, sf).groupBy(F.col("source")).agg(F.count("*").alias("n_gt"), F.count_if("has_image").alias("n_images"))
    want = spark.createDataFrame([("user", 20), ("assistant", 100000), ("system", 5), ("tool", 3)], "source string, want int")
    return A.source_status(counts, want)


def _receipts(spark, sf):
    """A receipt a sample: its words as lines, with every ninth box empty and blanks between."""
    w = D.words(spark, sf)
    x1 = F.when(F.col("pos") % 9 == 0, F.col("x")).otherwise(F.col("x") + F.col("w")).cast("double")
    box = F.array(F.col("x").cast("double"), F.col("y").cast("double"), x1, (F.col("y") + F.col("h")).cast("double"))
    text = F.when(F.col("pos") % 13 == 0, F.lit("  ")).otherwise(F.col("text"))
    rows = w.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t"), box.alias("b")))).alias("a"))
    return rows.select(F.col("sample_id").cast("string").alias("key"), F.transform("a", lambda z: z["t"]).alias("words"), F.transform("a", lambda z: z["b"]).alias("bboxes"), F.col("sample_id"))


def _flat(d: DataFrame, id_col: str, array: str) -> DataFrame:
    # outer, as the optimizer puts a filter on size below a plain one, which works the array out a second time
    r = d.select(id_col, F.posexplode_outer(array).alias("i", "g")).where("i is not null")
    return r.select(id_col, "i", *(F.get("g.bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")), F.col("g.text").alias("text"), F.col("g.type").alias("type"))


@query
def line_rows_to_lines(spark, sf):
    d = _receipts(spark, sf).select("key", A.receipt_lines(F.col("words"), F.col("bboxes")).alias("lines"))
    return _flat(d, "key", "lines").drop("type")


@query
def entity_to_line(spark, sf):
    def found(lines):
        n = F.greatest(F.size(lines), F.lit(1))
        pick = lambda i: F.get(lines, (F.col("sample_id") * i % n).cast("int"))["text"]
        return A.entity_boxes(lines, {"company": F.substring(pick(7), 1, 3), "address": pick(11), "total": F.lit("no such total")})

    d = _receipts(spark, sf).select("key", A.let(A.receipt_lines(F.col("words"), F.col("bboxes")), found).alias("pii"))
    return _flat(d, "key", "pii").drop("i")


@query
def nested_form_words(spark, sf):
    """Forms by way of JSON: an entry a row of text, with its words."""
    w = D.words(spark, sf).join(spread(D.chars(spark, sf).select("sample_id", "pos", "row")), ["sample_id", "pos"])
    corners = F.array(*(c.cast("double") for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))))
    entry = w.groupBy("sample_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", corners.alias("box"), "text"))).alias("a"))
    entry = entry.select("sample_id", "row", F.transform("a", lambda z: F.struct(z["box"].alias("box"), F.when(z["pos"] % 5 == 0, F.lit(" ")).otherwise(z["text"]).alias("text"))).alias("words"))
    form = entry.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("row", "words"))).alias("e"))
    made = form.select(F.col("sample_id").cast("string").alias("stem"), F.to_json(F.struct(F.transform("e", lambda z: F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("box"), F.lit("t").alias("text"), F.lit("question").alias("label"), z["words"].alias("words"))).alias("form"))).alias("json"))
    from ..functions.schemas import FORM

    parsed = made.select("stem", F.from_json("json", FORM).alias("f")).select("stem", A.form_words(F.col("f.form")).alias("words"))
    return _flat(parsed, "stem", "words").drop("type")


@query
def field_boxes(spark, sf):
    o = D.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = list(A.CHEQUE_FIELDS)
    made = {n: F.when((k + i) % 6 != 0, F.struct(*(e.cast("double").alias(a) for a, e in zip(("xmin", "ymin", "xmax", "ymax"), ((k + i * 3) % 90 + 0.5, c % 70 + 0.25, (k * 3 + i) % 200 + 0.75, (c * 5 + i) % 150 + 0.5), strict=True)))) for i, n in enumerate(names)}
    return _flat(o.select("o_orderkey", A.field_boxes(made).alias("pii")), "o_orderkey", "pii").drop("text")


@query
def labelled_regions(spark, sf):
    p = D.table(spark, sf, "part")
    k = F.col("p_partkey")
    names = F.element_at(F.array(*map(F.lit, ("face", "Photo", "doc", "surname", "number", ""))), (k % 6 + 1).cast("int"))
    shape = F.struct(
        F.when(k % 3 != 0, F.array((k % 50 + 0.5).cast("double"), (k % 70 + 9.0).cast("double"))).alias("all_points_x"), F.when(k % 3 != 0, F.array((k % 40).cast("double"), (k % 90 + 3.5).cast("double"))).alias("all_points_y"),
        F.when(k % 3 == 0, (k % 33).cast("double")).alias("x"), F.when(k % 3 == 0, (k % 44).cast("double")).alias("y"), F.when(k % 6 == 0, F.lit(12.0)).alias("width"), F.when(k % 6 == 0, F.lit(8.0)).alias("height"),
    )
    attributes = F.struct(names.alias("field_name"), F.when(k % 4 == 0, F.lit("given name")).alias("name"), F.col("p_name").alias("value"))
    region = F.struct(shape.alias("shape_attributes"), attributes.alias("region_attributes"))
    return _flat(p.select("p_partkey", A.labelled_regions(F.array(region)).alias("r")), "p_partkey", "r").drop("i")


@query
def char_word_split(spark, sf):
    w = D.words(spark, sf)
    pts = F.array(F.array("x", "y"), F.array(F.col("x") + F.col("w"), F.col("y")), F.array(F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    d = A.char_or_word(w.select(F.col("sample_id").cast("string").alias("page"), "text", pts.cast("array<array<double>>").alias("box")))
    return d.select("page", "kind", "text", *(F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")))


@query
def image_by_stem(spark, sf):
    p = D.table(spark, sf, "pages")
    k = F.col("page_id")
    ext = F.explode(F.when(k % 4 == 0, F.array(F.lit(".png"), F.lit(".jpg"))).when(k % 4 == 1, F.array(F.lit(".tif"))).when(k % 4 == 2, F.array(F.lit(".gif"))).otherwise(F.array(F.lit(".tif"), F.lit(".PNG"))))
    files = p.select(k.cast("string").alias("k"), ext.alias("ext")).select(F.concat(F.lit("/data/p"), "k", "ext").alias("path"))
    return A.image_by_stem(p.select(F.concat(F.lit("p"), k.cast("string")).alias("stem")), files)


@query
def review_apply(spark, sf):
    s = _sample_rows(spark, sf)
    k = F.col("sample_id").cast("long")
    words = F.when(k % 3 == 0, F.array(F.struct(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("bbox"), F.lit("new").alias("text")), F.struct(F.array(F.lit(5), F.lit(6), F.lit(7), F.lit(8)).alias("bbox"), F.concat(F.lit("w"), "sample_id").alias("text")))).otherwise(F.array().cast("array<struct<bbox:array<int>,text:string>>"))
    proposals = s.where("cast(sample_id as long) % 2 = 0").select("sample_id", F.lit("engine").alias("bootstrapped_with"), words.alias("words"))
    out, _ = A.apply_reviews(s, proposals, source="user")
    return out.select("sample_id", "source", F.size("words").alias("n_words"), "text")


@query
def review_unmatched(spark, sf):
    s = _sample_rows(spark, sf)
    proposals = s.select(F.when(F.col("source") == "user", F.concat(F.lit("x"), "sample_id")).otherwise(F.col("sample_id")).alias("sample_id"), F.lit("e").alias("bootstrapped_with"), F.array().cast("array<struct<bbox:array<int>,text:string>>").alias("words"))
    return A.apply_reviews(s, proposals)[1]


@query
def benchmark_union(spark, sf):
    """Samples of all sources and how many synthetic ones make up the total."""
    s = D.samples(spark, sf)
    parts = [s.where(F.col("source") == r).select("sample_id", F.lit(n).alias("source")) for r, n in (("user", "sroie"), ("assistant", "funsd"), ("system", "cheque"))]
    counts = A.gathered(parts).groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("synth", F.lit(A.synth_count(250)))


@query
def validate_samples(spark, sf):
    """Every sample, those without truth too: how many of each source pass and how many fail."""
    s = _sample_rows(spark, sf).withColumn("words", F.when(F.col("dpi") % 7 == 0, A.no_boxes()).otherwise(F.col("words")))
    checked = s.select("source", A.has_truth().alias("ok"))
    passed = A.validated(s.where(A.has_truth())).groupBy("source").agg(F.count("*").alias("passed"))
    return checked.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed")).join(passed, "source", "left").select("source", "n", "failed", F.coalesce("passed", F.lit(0)).alias("passed"))


@query
def json_round_trip(spark, sf):
    back = A.from_json(A.to_json(_sample_rows(spark, sf)))
    return back.select("sample_id", "source", "dpi", F.size("words").alias("n_words"), F.col("chars").isNull().alias("no_chars"), F.coalesce(F.size("chars"), F.lit(-1)).alias("n_chars"), F.element_at("meta", "template").alias("template"))


# rasters -----------------------------------------------------------------------------------------------------------


@query
def otsu_threshold(spark, sf):
    return raster.otsu_thresholds(D.pixels(spark, sf))


@query
def polarity(spark, sf):
    return raster.polarity(D.pixels(spark, sf))


@query
def otsu_binarize(spark, sf):
    return raster.otsu_binary(D.pixels(spark, sf))


def _inked(spark, sf):
    return raster.mapped(D.rasters(spark, sf), K.otsu)


@query
def connected_components(spark, sf):
    return raster.connected_components(_inked(spark, sf))


@query
def connected_components_4(spark, sf):
    return raster.connected_components(_inked(spark, sf), 4)


@query
def inverted_candidates(spark, sf):
    """Top components by area of each page that are large and well filled: the kernel's rule on each page's boxes."""
    boxes = _boxes(spark, sf).select("page", F.struct("id", *"xywh", "pixel_area").alias("c"))
    packed = boxes.groupBy("page").agg(F.collect_list("c").alias("c"))  # a page has some 160 boxes

    return packed.mapInArrow(raster.page_candidates, "page long, rank long, id long, pixel_area long")


@query
def looks_like_text(spark, sf):
    return raster.per_image(_inked(spark, sf), lambda a: [(K.looks_like_text(a),)], "text boolean")


@query
def label_map(spark, sf):
    return raster.as_pixels(raster.label_maps(_inked(spark, sf)))


@query
def sauvola_binarize(spark, sf):
    return raster.as_pixels(raster.mapped(D.rasters(spark, sf), lambda a: K.sauvola(a, Binarize(sauvola_window=3))))


@query
def adaptive_gaussian(spark, sf):
    return raster.as_pixels(raster.mapped(D.rasters(spark, sf), K.adaptive_gaussian))


@query
def illumination_normalise(spark, sf):
    return raster.as_pixels(raster.mapped(D.rasters(spark, sf), lambda a: K.normalize_illumination(a, 3)))


@query
def fill_holes(spark, sf):
    return raster.as_pixels(raster.mapped(_inked(spark, sf), lambda a: K.fill_holes(a).astype("uint8") * 255))


@query
def median_denoise(spark, sf):
    return raster.as_pixels(raster.mapped(D.rasters(spark, sf), K.median3))


@query
def grayscale(spark, sf):
    """The first 48 values of each raster as 4 x 4 pixels of blue, green and red."""
    return raster.as_pixels(raster.mapped(D.rasters(spark, sf), lambda a: K.grayscale(a.ravel()[:48].reshape(4, 4, 3))))


@query
def resize_half(spark, sf):
    return raster.as_pixels(raster.mapped(D.rasters(spark, sf), lambda a: K.resize(a, 0.5)))


@query
def inverted_pixels(spark, sf):
    return D.pixels(spark, sf).join(raster.polarity(D.pixels(spark, sf)).withColumnRenamed("image", "_i"), F.col("image") == F.col("_i")).select("image", "y", "x", F.when(F.col("inverted"), 255 - F.col("v")).otherwise(F.col("v")).alias("v"))


@query
def page_pipeline(spark, sf):
    """Images to routed components, end to end, over rasters enlarged by the preprocessing itself."""
    data = F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    images = D.rasters(spark, sf).select(F.col("image").cast("string").alias("sample_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"))
    images = images.repartition(spark.sparkContext.defaultParallelism)  # one small file, and kernels that take long for its size
    return raster.page_results(raster.run_pages(images, Settings(preprocess=Preprocess(min_side=64))))


@query
def constant_pages(spark, sf):
    """End to end over pages whose boxes are known: a row of 13 bars of ink on each, as high as the page's number says."""
    d = D.table(spark, sf, "part").select("p_partkey", (4 + F.col("p_partkey") % 5).cast("int").alias("high"))
    d = d.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # keys of a few small files, each a page of pixels
    bar, gap = F.lit("00" * 3), F.lit("FF" * 5)
    inked = F.concat(gap, F.repeat(F.concat(bar, gap), 13))
    rows = F.concat(F.repeat(F.lit("FF" * 109), 20), F.array_join(F.array_repeat(inked, F.col("high")), ""), F.repeat(F.lit("FF" * 109), 20))
    images = d.select(F.col("p_partkey").cast("string").alias("sample_id"), (40 + F.col("high")).alias("height"), F.lit(109).alias("width"), F.lit(1).alias("n_channels"), F.unhex(rows).alias("data"))
    s = Settings(preprocess=Preprocess(upscale=False, normalize_illumination=False), binarize=Binarize(method="otsu", recover_inverted=False))
    return raster.run_pages(images, s).select("sample_id", *"xywh", "pixel_area", "kind", "reason")


# text and synthesis ------------------------------------------------------------------------------------------------


@query
def nric_checksum(spark, sf):
    k = F.col("o_orderkey")
    prefix = F.substring(F.lit("STFG"), (k % 4 + 1).cast("int"), F.lit(1))
    digits = F.lpad(((k * 7919 + 13) % 10_000_000).cast("string"), 7, "0")
    number = F.concat(prefix, digits, X.nric_letter(prefix, digits))
    return D.table(spark, sf, "orders").select("o_orderkey", number.alias("nric"), X.nric_valid(number).alias("valid"), X.nric_valid(F.concat(F.substring(number, 1, 8), F.lit("Y"))).alias("y_valid"))


def _cents(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", F.bround(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query
def amount_in_words(spark, sf):
    return _cents(spark, sf).select("o_orderkey", X.amount_in_words(F.col("cents")).alias("words"))


@query
def money_format(spark, sf):
    return _cents(spark, sf).select("o_orderkey", X.money(F.col("cents") / F.lit(100.0)).alias("money"))


@query
def mrz_lines(spark, sf):
    c = D.table(spark, sf, "customer")
    k = F.col("c_custkey")
    a, b = X.mrz_lines(F.col("c_mktsegment"), F.col("c_name"), F.concat(F.lit("K"), k.cast("string")), F.date_add(F.lit("1950-01-01").cast("date"), (k * 37 % 20000).cast("int")), F.date_add(F.lit("2031-01-01").cast("date"), (k % 300).cast("int")), F.substring(F.lit("MF"), (k % 2 + 1).cast("int"), F.lit(1)), F.lpad((k * 31 % 100000).cast("string"), 5, "0"))
    return c.select("c_custkey", a.alias("line1"), b.alias("line2"))


@query
def account_numbers(spark, sf):
    k = F.col("c_custkey")
    return D.table(spark, sf, "customer").select("c_custkey", X.account_number(100 + k % 899, 100000 + k * 7 % 899999, k % 9).alias("account"))


@query
def word_tokens(spark, sf):
    t = D.samples(spark, sf).select("sample_id", F.explode(X.tokens(F.col("text"))).alias("t"))
    return t.select("sample_id", F.col("t.start").alias("start"), F.col("t.word").alias("word"))


@query
def char_boxes(spark, sf):
    return D.chars(spark, sf)


@query
def line_boxes(spark, sf):
    return D.lines(spark, sf)


@query
def word_boxes(spark, sf):
    return D.words(spark, sf)


@query
def text_joins(spark, sf):
    d = _receipts(spark, sf).select("key", A.receipt_lines(F.col("words"), F.col("bboxes")).alias("lines"))
    return d.select("key", X.flatten_text(F.col("lines")).alias("text"))


@query
def homography_boxes(spark, sf):
    b = _boxes(spark, sf)
    m = [0.9, 0.1, -20.0, -0.05, 1.1, 15.0, 1e-4, 5e-5, 1.0]
    moved = G.homography_box(Box.of(), [F.lit(v) for v in m], F.lit(900), F.lit(800))
    return b.select("page", "id", G.kept(moved))


@query
def stratum_sequence(spark, sf):
    d = D.samples(spark, sf).select(F.col("sample_id").alias("i"), F.when(F.col("template") == "", "plain").otherwise(F.col("template")).alias("template"))
    return synth.numbered(d)


@query
def script_sets(spark, sf):
    """Scripts that occur, less those that can't be drawn; and both."""
    return synth.script_sets(D.samples(spark, sf).select("script"), spark.createDataFrame([("thai",), ("arabic",)], "script string"))


@query
def strata_available(spark, sf):
    """Strata that stay where two scripts can't be drawn, with their profiles."""
    rows = [(t, w, p, x) for t, w, options in synth.available(synth.STRATA, {"thai", "arabic"}) for p, x in options.items()]
    return spark.createDataFrame(rows, "template string, weight double, profile string, share double")


@query
def capture_profiles(spark, sf):
    return synth.profiles(spark)


@query
def overlay_kinds(spark, sf):
    from ..operators.overlays import drawn

    return drawn(D.components(spark, sf), ("diacritic", "rule")).select("sample_id", "id", "kind")


@query
def overlay_sample(spark, sf):
    """The limit is the feature: so many samples by a hash of their id."""
    from ..operators.overlays import sampled

    return sampled(D.samples(spark, sf).select("sample_id"), 25, 7)


@query
def review_todo(spark, sf):
    """The limit is the feature: so many samples of a source that have an image and no proposal."""
    s = D.samples(spark, sf)
    return A.proposals_todo(s, _pictures(spark, sf), s.where("sample_id % 3 = 0"), "user", 40).select("sample_id")


@query
def review_todo_all(spark, sf):
    s = D.samples(spark, sf)
    return A.proposals_todo(s, _pictures(spark, sf), s.where("sample_id % 3 = 0"), "assistant").select("sample_id")


@query
def path_capture(spark, sf):
    """Stem, parent folder and capture of image paths."""
    k = F.col("page_id")
    path = F.concat(F.lit("/data/"), F.when(k % 3 == 0, "Photos").when(k % 3 == 1, "scans").otherwise("my.photo_set"), F.lit("/p"), k.cast("string"), F.when(k % 2 == 0, ".v1.png").otherwise(".jpg"))
    return D.table(spark, sf, "pages").select("page_id", *A.path_parts(path))


@query
def percent_format(spark, sf):
    d = D.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 9 != 0, (F.col("o_orderkey") % 997) / F.lit(997.0)).alias("rate"))
    return d.select("o_orderkey", reports.percent(F.col("rate")).alias("text"))


@query
def generation_tallies(spark, sf):
    s = D.samples(spark, sf).withColumn("has_chars", F.col("sample_id") % 3 == 0)
    return reports.tallies(s)


@query
def person_names(spark, sf):
    k = F.col("c_custkey")
    return D.table(spark, sf, "customer").select("c_custkey", X.person_name(k).alias("name"), F.array_join(X.address(k), "; ").alias("address"))


@query
def field_dates(spark, sf):
    k = F.col("c_custkey")
    born, issued = X.birth_date(k * 37), X.recent_date(k * 13)
    return D.table(spark, sf, "customer").select("c_custkey", F.date_format(born, "dd MMM yyyy").alias("born"), F.date_format(issued, "dd/MM/yyyy").alias("issued"), F.date_format(issued, "yyyy-MM-dd").alias("iso"))


@query
def page_layout(spark, sf):
    """Lines of text laid out, a box a character."""
    s = D.samples(spark, sf).select("sample_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return synth.layout(s).drop("ch")


@query
def zipped_boxes(spark, sf):
    """Annotations behind a move of their boxes, told apart by kind and place; those that leave the frame drop out."""
    w = D.words(spark, sf).select("sample_id", F.lit("word").alias("what"), "pos", "text", *"xywh")
    n = D.nontext(spark, sf).select("sample_id", F.lit("nontext").alias("what"), "pos", F.lit("").alias("text"), *"xywh")
    ids = D.samples(spark, sf).select("sample_id", *(F.lit(v).alias(f"m{i}") for i, v in enumerate((0.5, 0.0, 30.0, 0.0, 0.5, -20.0, 0.0, 0.0, 1.0))))
    return synth.degrade_boxes(w.unionByName(n), ids, 400, 300)


@query
def synth_plan(spark, sf):
    return synth.plan(spark, 30, 3).select("i", "sample_id", "template", "profile", "capture", "seed")


@query
def windowed_latency(spark, sf):
    from ..streaming.latency import windowed_latency as f

    d = f(D.table(spark, sf, "events"))
    return d.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stage", "n", F.round("mean", 6).alias("mean"), "max")
