"""Component routing: absolute gates, a robust scale of each page, and gates relative to it.

Components are rows (page, id, x, y, w, h, pixel_area, fill_ratio). Every step is a column expression or a join on
the page; the page's statistics are windows over the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Route
from ..functions.geometry import Box
from .spatial import spread

KINDS = ("text", "diacritic", "rule", "blob", "noise")
CELL = 64


def absolute(page_w: Column, page_h: Column, s: Route) -> Column:
    """struct<kind, reason> of a component by its own geometry; the first gate that fits decides."""
    b, fill = Box.of(), F.col("fill_ratio")
    to = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    oversized = (b.w > s.oversized_frac * page_w) | (b.h > s.oversized_frac * page_h)
    long = (b.aspect >= s.oversized_rule_aspect) | (b.aspect <= s.vertical_aspect)
    return (
        F.when((F.col("pixel_area") < s.min_pixel_area) | ((b.h < s.min_side) & (b.w < s.min_side)), to("noise", "t1:degenerate"))
        .when(oversized & (fill < s.hollow_fill), to("rule", "t1:frame"))
        .when(oversized & long & (fill >= s.rule_fill), to("rule", "t1:oversized_rule"))
        .when(oversized, to("blob", "t1:oversized"))
        .when(b.aspect <= s.vertical_aspect, to("rule", "t1:vertical_rule"))
        .when((b.aspect >= s.horizontal_aspect) & (fill >= s.rule_fill), to("rule", "t1:horizontal_rule"))
        .when(b.aspect >= s.horizontal_aspect, to("text", ""))
        .when(fill < s.hollow_fill, to("rule", "t1:hollow"))
        .otherwise(to("text", ""))
    )


def route_absolute(components: DataFrame, page_w: int = 1000, page_h: int = 1000, s: Route = Route()) -> DataFrame:
    routed = components.withColumn("_to", absolute(F.lit(page_w), F.lit(page_h), s))
    return routed.withColumn("kind", F.col("_to.kind")).withColumn("reason", F.col("_to.reason")).drop("_to")


def weighted_median(rows: DataFrame, key: str = "page", quantile: float = 0.95) -> DataFrame:
    """key, median: the height at which half of the ink, capped at a quantile of areas, is reached. A row a key.

    Rows are counted by (key, height, area) first, so the windows run over a page's distinct values and not over its components.
    """
    page = W.partitionBy(key)
    counted = rows.groupBy(key, "h", "pixel_area").agg(F.count("*").alias("n"))
    upto, total = F.sum("n").over(page.orderBy("pixel_area")), F.sum("n").over(page)  # a running sum takes equal areas together
    place = F.floor(F.lit(quantile) * (total - 1))
    counted = counted.withColumn("inside", F.when(upto > place, F.col("pixel_area")))
    cap = F.greatest(F.lit(1), F.min("inside").over(page))
    heights = counted.withColumn("ink", F.col("n") * F.least("pixel_area", cap)).groupBy(key, "h").agg(F.sum("ink").alias("ink"))
    half = F.sum("ink").over(page.orderBy("h")) * 2 >= F.sum("ink").over(page)
    return heights.select(key, "h", half.alias("half")).where("half").groupBy(key).agg(F.min("h").alias("median"))


def with_parent(small: DataFrame, parents: DataFrame, s: Route) -> DataFrame:
    """Rows of small (page, id, box, median) that have a parent: enough overlap in x and a small enough gap in y."""
    a, b = Box.of(), Box.of("p_")
    gap = F.greatest(b.y - a.y2, a.y - b.y2, F.lit(0))
    fits = (F.least(a.x2, b.x2) - F.greatest(a.x, b.x) >= s.parent_x_overlap * a.w) & (gap <= s.parent_gap * F.col("median")) & (F.col("id") != F.col("p_id"))
    reach = s.parent_gap * F.col("median")
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL).cast("int"), F.floor(hi / CELL).cast("int")))
    p = parents.withColumn("p_gx", cells(F.col("x"), F.col("x") + F.col("w"))).withColumn("p_gy", cells(F.greatest(F.lit(0), F.col("y") - reach - s.under_median * F.col("median") - 1), F.col("y") + F.col("h") + reach))
    p = p.select(F.col("page").alias("p_page"), F.col("id").alias("p_id"), *Box.of().columns("p_"), "p_gx", "p_gy")
    posted = small.withColumn("gx", cells(F.col("x"), F.col("x") + F.col("w"))).withColumn("gy", F.floor(F.col("y") / CELL).cast("int"))
    on = (F.col("page") == F.col("p_page")) & (F.col("gx") == F.col("p_gx")) & (F.col("gy") == F.col("p_gy"))
    return posted.join(spread(p), on & fits, "left_semi").select("page", "id").distinct()


def scaled_pages(routed: DataFrame, page_area: int, s: Route) -> DataFrame:
    """routed with columns dense, on (the relative gates run) and median of its page (0 where they don't).

    The median is that of weighted_median, by windows over the page that the counts need anyway: one exchange, and the rows are not joined with a page's figures.
    """
    page = W.partitionBy("page")
    text = F.col("kind") == "text"
    first = F.count(F.when(text, 1)).over(page) >= s.least_text
    dense = text & F.col("_first") & (F.col("pixel_area") > s.dense_area_frac * page_area)
    marked = routed.withColumn("_first", first & F.lit(s.relative)).withColumn("dense", dense)
    left = F.count(F.when(text & ~F.col("dense"), 1)).over(page) >= s.least_text
    marked = marked.withColumn("on", F.col("_first") & left)
    marked = marked.withColumn("_live", F.col("on") & text & ~F.col("dense"))
    place, n = F.row_number().over(page.orderBy(~F.col("_live"), "pixel_area")) - 1, F.count(F.when(F.col("_live"), 1)).over(page)
    marked = marked.withColumn("_at", F.when(place == F.floor(F.lit(s.cap_quantile) * (n - 1)), F.col("pixel_area")))
    ink = F.when(F.col("_live"), F.least("pixel_area", F.greatest(F.lit(1), F.max("_at").over(page))))
    marked = marked.withColumn("_ink", ink)
    half = F.sum("_ink").over(page.orderBy("h")) * 2 >= F.sum("_ink").over(page)
    marked = marked.withColumn("_half", F.when(F.col("_live") & half, F.col("h")))
    return marked.withColumn("median", F.coalesce(F.min("_half").over(page), F.lit(0))).drop("_first", "_live", "_at", "_ink", "_half")


def route_relative(routed: DataFrame, page_area: int = 1_000_000, s: Route = Route()) -> DataFrame:
    """Second tier on the output of route_absolute; keeps columns median and on."""
    marked = scaled_pages(routed, page_area, s)
    live = marked.where("on and kind = 'text' and not dense")
    small = live.where(F.col("h") < s.under_median * F.col("median"))
    normal = live.where(F.col("h") >= s.normal_median * F.col("median"))
    child = with_parent(small, normal, s).select(F.col("page").alias("_page"), F.col("id").alias("_id"), F.lit(True).alias("child"))
    out = marked.join(child, (F.col("page") == F.col("_page")) & (F.col("id") == F.col("_id")), "left").drop("_page", "_id")
    m, h = F.col("median"), F.col("h")
    live = F.col("on") & (F.col("kind") == "text") & ~F.col("dense")
    to = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    new = (
        F.when(F.col("dense"), to("blob", "t2:dense_region"))
        .when(live & (h > s.over_median * m), to("blob", "t2:oversized_vs_median"))
        .when(live & (h < s.under_median * m) & F.coalesce("child", F.lit(False)) & (h <= s.diacritic_median * m), to("diacritic", "t2:diacritic"))
        .when(live & (h < s.under_median * m), to("noise", "t2:small_orphan"))
        .otherwise(F.struct("kind", "reason"))
    )
    return out.withColumn("_to", new).withColumn("kind", F.col("_to.kind")).withColumn("reason", F.col("_to.reason")).drop("_to", "child", "dense")


def route(components: DataFrame, page_w: int = 1000, page_h: int = 1000, s: Route = Route()) -> DataFrame:
    return route_relative(route_absolute(components, page_w, page_h, s), page_w * page_h, s)


def kind_counts(rows: DataFrame, key: str = "page") -> DataFrame:
    """Counts of every kind, also those that don't occur."""
    return rows.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))


def filter_stats(routed: DataFrame) -> DataFrame:
    """page, total, median_height, relative_gates_applied and counts of kinds."""
    return routed.groupBy("page").agg(
        F.count("*").alias("total"), F.bround(F.max("median").cast("double"), 2).alias("median_height"), F.bool_or("on").alias("relative_gates_applied"),
        *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS),
    )
