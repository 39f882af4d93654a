"""Relations that the queries run on, derived from whole tables by integer arithmetic alone.

boxes: components on pages, from lineitem. samples, chars, words, lines, nontext, components: a page layout of fixed pitch for each turn
of conversations, and components with known faults. timings: from events. rasters: 8 x 8 images from embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

COLUMNS, PITCH_X, PITCH_Y, MARGIN = 60, 14, 30, 20
ORDERS_A_PAGE = 40
SPACE = (" ", "\n", "\t", "\r")
SMALL = list(".,;:!?'\"-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, id, x, y, w, h, pixel_area, fill_ratio. Pages hold some 160 boxes each, so their number grows with the table."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    # up to which r, then width, height and fill in percent, each as a base and a modulus of a key
    classes = [
        (59, (6, 10), (14, 10), (40, 40)), (69, (2, 3), (2, 3), (95, 1)), (74, (200, 1), (2, 1), (95, 1)), (77, (2, 1), (150, 1), (95, 1)), (80, (700, 1), (700, 1), (3, 1)), (83, (650, 1), (650, 1), (85, 1)),
        (86, (60, 1), (40, 1), (8, 1)), (89, (200, 1), (14, 1), (25, 1)), (92, (1, 1), (1, 1), (60, 1)), (95, (24, 1), (100, 1), (60, 1)), (97, (300, 1), (300, 1), (60, 1)), (99, (800, 1), (20, 1), (90, 1)),
    ]
    of_r = [next(row for row in classes if r <= row[0]) for r in range(100)]
    at = lambda i, k: F.element_at(F.lit([row[i + 1][k] for row in of_r]), (F.col("r") + 1).cast("int"))
    pick = lambda i, key: (at(i, 0) + key % at(i, 1)).cast("int")
    line = table(spark, sf_dir, "lineitem").withColumn("r", (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + part) % 100)
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    sized = line.select(
        F.floor(F.col("l_orderkey") / ORDERS_A_PAGE).cast("int").alias("page"), *keys, ((part * 13 + F.col("l_linenumber") * 17) % 900).cast("int").alias("x"), ((F.col("l_orderkey") * 11 + supp * 29) % 900).cast("int").alias("y"),
        # a generator keeps these from being worked out anew wherever a width or a height is used
        F.inline(F.array(F.struct(pick(0, part).alias("w"), pick(1, supp).alias("h"), pick(2, part).alias("pct")))),
    )
    out = sized.withColumn("id", F.row_number().over(W.partitionBy("page").orderBy(*keys))).drop(*keys)
    area = F.greatest(F.lit(1), F.floor(F.col("w") * F.col("h") * F.col("pct") / 100)).cast("int")
    return out.withColumn("pixel_area", area).withColumn("fill_ratio", F.col("pixel_area") / (F.col("w") * F.col("h")).cast("double")).select("page", "id", "x", "y", "w", "h", "pixel_area", "fill_ratio")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, source, capture, script, dpi, template, gt_complete, has_image, text."""
    c, t = F.col("conv_id"), F.col("turn")
    sid = c * 1000 + t
    pick = lambda n, k, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % k + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        sid.alias("sample_id"), F.col("role").alias("source"), pick(c, 3, "scan", "photo", "digital").alias("capture"), pick(c, 4, "latin", "han", "thai", "latin").alias("script"),
        (75 + (sid * 37) % 250).cast("int").alias("dpi"), pick(t, 4, "", "receipt", "form", "id_card").alias("template"), (c % 5 != 0).alias("gt_complete"), (sid % 11 != 0).alias("has_image"), F.coalesce("text", F.lit("")).alias("text"),
    )


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, pos, ch, row, x, y, w, h: every character of every text but white space."""
    exploded = samples(spark, sf_dir).select("sample_id", F.posexplode(F.split("text", "")).alias("pos", "ch")).where((F.col("ch") != "") & ~F.col("ch").isin(*SPACE))
    small, lower = F.col("ch").isin(*SMALL), F.col("ch").rlike("^[a-z]$")
    row = F.floor(F.col("pos") / COLUMNS).cast("int")
    return exploded.select(
        "sample_id", "pos", "ch", row.alias("row"), (MARGIN + PITCH_X * (F.col("pos") % COLUMNS)).cast("int").alias("x"), (MARGIN + PITCH_Y * row).alias("y"),
        F.when(small, 4).otherwise(10).alias("w"), F.when(small, 4).when(lower, 14).otherwise(20).alias("h"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, pos, text, x, y, w, h: runs of characters in a row; pos is that of the first character."""
    run = F.col("pos") - F.row_number().over(W.partitionBy("sample_id", "row").orderBy("pos"))
    grouped = chars(spark, sf_dir).withColumn("run", run).groupBy("sample_id", "row", "run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda s: s["ch"]), "")
    return grouped.agg(F.min("pos").alias("pos"), text.alias("text"), *_union()).drop("row", "run")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chars(spark, sf_dir).groupBy("sample_id", "row").agg(*_union()).withColumnRenamed("row", "pos")


def _union() -> list:
    from ..functions.geometry import union_of

    return union_of()


def gt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the samples that are annotated by word; the others have lines only."""
    return words(spark, sf_dir).where("sample_id % 4 <> 1")


def nontext(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = words(spark, sf_dir).where("(sample_id + pos) % 9 = 0")
    return marked.select("sample_id", "pos", (F.col("x") - 2).alias("x"), (F.col("y") - 2).alias("y"), (F.col("w") + 4).alias("w"), (F.col("h") + 4).alias("h"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, id, x, y, w, h, pixel_area, kind: one or two components a character, with faults by a fixed rule."""
    r, x, y, w, h = (F.col(c) for c in ("r", "x", "y", "w", "h"))
    box = lambda k, *b: F.struct(F.lit(k).alias("k"), *(c.cast("int").alias(n) for n, c in zip("xywh", b, strict=True)))
    cut = F.greatest(F.lit(1), F.floor(h * 45 / 100))
    exact = box(0, x, y, w, h)
    made = (
        F.when(r < 60, F.array(exact))
        .when(r < 70, F.array(box(0, x, y, w + PITCH_X, h)))
        .when(r < 78, F.array(box(0, x, y, w, cut), box(1, x, y + h - cut, w, cut)))
        .when(r < 85, F.array().cast("array<struct<k:int,x:int,y:int,w:int,h:int>>"))
        .when(r < 93, F.array(box(0, x + 3, y + 4, w, h)))
        .otherwise(F.array(exact, box(1, x, y + 24, F.lit(3), F.lit(3))))
    )
    out = chars(spark, sf_dir).withColumn("r", (F.col("sample_id") * 31 + F.col("pos") * 17) % 100).withColumn("c", F.explode(made))
    kind = F.when(r.isin(85, 86), "noise").when(r == 87, "diacritic").when(r == 59, "rule").otherwise("text")
    out = out.select("sample_id", (F.col("pos") * 2 + F.col("c.k")).alias("id"), *(F.col(f"c.{n}").alias(n) for n in "xywh"), kind.alias("kind"))
    return out.withColumn("pixel_area", F.greatest(F.lit(1), F.floor(w * h * 60 / 100)).cast("int"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("document"), F.get_json_object("props", "$.k").cast("int").alias("repeat"), F.col("event_type").alias("stage"), F.col("value").cast("double").alias("ms"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, w, v: 8 x 8 rasters, an array an image."""
    gray = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128) + F.lit(200) * e.cast("double")))).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.lit(8).alias("w"), F.transform("embedding", gray).alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, y, x, v of 8 x 8 rasters."""
    from ..operators.raster import as_pixels

    return as_pixels(rasters(spark, sf_dir))
