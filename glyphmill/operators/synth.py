"""Synthetic pages: a plan of weighted strata, fixed-pitch layout, capture profiles and the boxes' way through a homography."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import Box, homography_box, kept

#: Capture profiles (capture, rotation, perspective, blur, noise, illumination, quality, least and most scale, moire).
PROFILES = {
    "digital": ("digital", 0.0, 0.0, 0.0, 0.0, 0.0, 0, 1.0, 1.0, 0.0),
    "clean_scan": ("scan", 0.6, 0.0, 0.4, 2.0, 0.0, 92, 0.9, 1.0, 0.0),
    "scan": ("scan", 1.8, 0.0, 0.8, 4.0, 0.12, 80, 0.55, 0.9, 0.0),
    "photo": ("photo", 2.5, 0.025, 1.1, 6.0, 0.38, 72, 0.5, 0.85, 0.0),
    "hard_photo": ("photo", 5.0, 0.055, 2.0, 10.0, 0.55, 48, 0.3, 0.55, 0.10),
}
#: Strata (template, weight, profiles and their weights).
STRATA = [
    ("id_card", 0.24, {"photo": 0.5, "scan": 0.25, "hard_photo": 0.15, "clean_scan": 0.10}),
    ("cheque", 0.18, {"photo": 0.4, "scan": 0.35, "hard_photo": 0.15, "clean_scan": 0.10}),
    ("receipt", 0.16, {"photo": 0.45, "scan": 0.35, "hard_photo": 0.20}),
    ("form", 0.14, {"scan": 0.55, "clean_scan": 0.2, "photo": 0.25}),
    ("plain_latin", 0.10, {"scan": 0.5, "clean_scan": 0.3, "photo": 0.2}),
    ("plain_han", 0.05, {"scan": 0.6, "photo": 0.4}),
    ("plain_devanagari", 0.05, {"scan": 0.6, "photo": 0.4}),
    ("plain_thai", 0.04, {"scan": 0.6, "photo": 0.4}),
    ("plain_arabic", 0.04, {"scan": 0.6, "photo": 0.4}),
]
PROFILE_SCHEMA = "profile string, capture string, rotation double, perspective double, blur double, noise double, illumination double, quality int, scale_low double, scale_high double, moire double"


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], PROFILE_SCHEMA)


def available(strata: list[tuple], blocked_scripts: set[str]) -> list[tuple]:
    """Strata whose script can be drawn; Latin text and templates that aren't plain text always stay."""
    return [s for s in strata if not s[0].startswith("plain_") or s[0] == "plain_latin" or s[0].removeprefix("plain_") not in blocked_scripts]


def script_sets(scripts: DataFrame, blocked: DataFrame) -> DataFrame:
    """script, status: scripts that occur and can be drawn, and those that can't."""
    s = scripts.distinct()
    return s.exceptAll(blocked).withColumn("status", F.lit("available")).unionByName(s.intersect(blocked).withColumn("status", F.lit("blocked")))


def plan(spark: SparkSession, count: int, seed: int, strata: list[tuple] = STRATA, blocked_scripts: set[str] = frozenset()) -> DataFrame:
    """i, sample_id, template, profile, capture, seed: the same for the same seed. One generator draws a template, then a profile, for each sample in turn."""
    usable = available(strata, set(blocked_scripts))
    rng, rows = random.Random(seed), []
    for i in range(count):
        template, _, options = rng.choices(usable, weights=[s[1] for s in usable])[0]
        rows.append((i, template, rng.choices(list(options), weights=list(options.values()))[0], seed * 100003 + i))
    d = spark.createDataFrame(rows, "i int, template string, profile string, seed long")
    return numbered(d).join(F.broadcast(profiles(spark).select("profile", "capture")), "profile")  # five profiles


def numbered(d: DataFrame) -> DataFrame:
    """Running number within a template as synth_<template>_0000."""
    n = F.row_number().over(W.partitionBy("template").orderBy("i")) - 1
    return d.withColumn("sample_id", F.format_string("synth_%s_%04d", "template", n))


def layout(lines: DataFrame, pitch_x: int = 14, pitch_y: int = 30, margin: int = 20, w: int = 10, h: int = 20) -> DataFrame:
    """sample_id, line, pos, ch, x, y, w, h of lines (sample_id, line, text): one box a character but white space."""
    chars = lines.select("sample_id", "line", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> '' and trim(ch) <> ''")
    return chars.select("sample_id", "line", "pos", "ch", (margin + pitch_x * F.col("pos")).alias("x"), (margin + pitch_y * F.col("line")).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))


def degrade_boxes(boxes: DataFrame, matrices: DataFrame, width: int, height: int) -> DataFrame:
    """boxes (sample_id, .., x, y, w, h) moved by their sample's matrix (m0..m8); what leaves the page is dropped."""
    m = matrices.withColumnRenamed("sample_id", "_id")
    d = boxes.join(m, F.col("sample_id") == F.col("_id"))
    moved = homography_box(Box.of(), [F.col(f"m{i}") for i in range(9)], F.lit(width), F.lit(height))
    return d.select(*(c for c in boxes.columns if c not in "xywh"), kept(moved))


def rotation_matrices(samples: DataFrame, width: int, height: int) -> DataFrame:
    """m0..m8 for samples (sample_id, degrees, scale): a turn about the page's middle, then a scaling from its origin."""
    a, s = F.radians("degrees"), F.col("scale")
    cx, cy = width / 2, height / 2
    c, n = F.cos(a), F.sin(a)
    rows = [c * s, n * s, (F.lit(cx) - c * cx - n * cy) * s, -n * s, c * s, (F.lit(cy) + n * cx - c * cy) * s, F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return samples.select("sample_id", *(m.alias(f"m{i}") for i, m in enumerate(rows)))


#: Boxes of a page by what they annotate, in the order in which they go through the capture.
PARTS = ("lines", "words", "chars", "pii", "regions_nontext")
MADE = "sample_id string, source string, capture string, script string, dpi int, text string, template string, profile string, seed long, height int, width int, n_channels int, data binary, boxes array<struct<what:string,pos:int,text:string,type:string,x:int,y:int,w:int,h:int>>"


def generate(planned: DataFrame) -> DataFrame:
    """Pages of a plan: facts, pixels and the annotations whose boxes are still in the frame. A row depends on its own template, profile and seed alone.

    Plain pages of other scripts carry Latin letters and say so in their script; other scripts' letters need fonts, which aren't here.
    """
    import pyarrow as pa

    from ..functions import capture, pages

    def run(batches):
        schema = pa.schema([(n, t) for n, t in zip(("what", "pos", "text", "type", "x", "y", "w", "h"), (pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4), strict=True)])
        box = pa.struct(list(schema))
        for batch in batches:
            for r in batch.to_pylist():
                rng = random.Random(r["seed"])
                page = pages.page(r["template"], rng)
                image, boxes, scale = capture.degrade(page.image, [b[4:] for b in page.boxes], capture.Profile(r["profile"], *PROFILES[r["profile"]]), rng)
                kept = [dict(zip(schema.names, (*b[:4], *moved), strict=True)) for b, moved in zip(page.boxes, boxes, strict=True) if moved is not None]
                row = [r["sample_id"], "synth", r["capture"], "latin", round(pages.DPI * scale), page.text, r["template"], r["profile"], r["seed"], image.shape[0], image.shape[1], 1, image.tobytes(), kept]
                types = [pa.string()] * 4 + [pa.int32()] + [pa.string()] * 3 + [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(box)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in MADE.split(", ")])

    # a page is rendered in milliseconds to tenths of seconds: spread the plan, which comes from the driver in few partitions
    spread = planned.repartition(planned.sparkSession.sparkContext.defaultParallelism, "seed")
    return spread.select("sample_id", "template", "profile", "capture", "seed").mapInArrow(run, MADE)


def as_samples(made: DataFrame) -> DataFrame:
    """The nested schema of samples, of what generate gives."""
    def of(what: str):
        return F.transform(F.filter("boxes", lambda b: b["what"] == what), lambda b: F.struct(F.array(b["x"], b["y"], b["w"], b["h"]).alias("bbox"), b["text"].alias("text"), b["type"].alias("type")))

    chars = F.transform(F.filter("boxes", lambda b: b["what"] == "chars"), lambda b: F.struct(F.array(b["x"], b["y"], b["w"], b["h"]).alias("bbox"), b["text"].alias("char")))
    meta = F.create_map(F.lit("template"), F.col("template"), F.lit("profile"), F.col("profile"), F.lit("seed"), F.col("seed").cast("string"), F.lit("gt_complete"), F.lit("true"))
    return made.select("sample_id", "source", "capture", "script", "dpi", "text", of("lines").alias("lines"), of("words").alias("words"), chars.alias("chars"), of("pii").alias("pii"), of("regions_nontext").alias("regions_nontext"), meta.alias("meta"))
