"""Images to components: kernels in Arrow batches, everything behind them as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Settings
from ..functions import kernels
from ..functions.geometry import Box, scaled
from .routing import KINDS, absolute, route_relative

PAGE = "sample_id string, width int, height int, scale double, polarity_inverted boolean, recovered int"
COMPONENT = "id int, x int, y int, w int, h int, pixel_area int, cx double, cy double, fill_ratio double"
#: Components from which a batch ends.
ROWS = 4096


def decoded(image: Column) -> Column:
    """Raises on images that the source couldn't decode (read with dropInvalid false)."""
    return F.when(image["width"] < 1, F.raise_error(F.concat(F.lit("undecodable image: "), image["origin"])).cast("binary")).otherwise(image["data"])


def label_images(images: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Page facts and components of images (sample_id, height, width, n_channels, data): a row a component, and one with
    a null id for a page without any."""
    spec = images.select("sample_id", "height", "width", "n_channels", "data")

    types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int32(), *[pa.int32()] * 6, *[pa.float64()] * 3]
    names = [c.split()[0] for c in f"{PAGE}, {COMPONENT}".split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []  # of several pages: a batch a page would cost more than a small page's kernels
            for sample_id, height, width, n_channels, data in zip(*batch.columns, strict=True):
                shape = (height.as_py(), width.as_py(), n_channels.as_py())
                image = np.frombuffer(data.as_buffer(), np.uint8).reshape(shape)  # a view: a batch may hold many pages
                facts, found = kernels.label_page(image[..., 0] if shape[2] == 1 else image, s)
                page = (sample_id.as_py(), *facts.values())
                rows += [(*page, *c, c[5] / (c[3] * c[4])) for c in found] or [(*page, *[None] * 9)]
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    return spec.mapInArrow(run, f"{PAGE}, {COMPONENT}")


def once(rows: DataFrame) -> DataFrame:
    """rows kept where they are made, in the checkpoint folder or, without one, on the executors' disks.

    Routing reads a page's components several times, and a plan that reads a Python kernel several times runs it as often. Components are few next to pixels.
    """
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist(StorageLevel.DISK_ONLY)


def run_pages(images: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Components with kind and reason; boxes and centroids in the frame of the original image, pixel_area in that of processing."""
    found = once(label_images(images, s).where("id is not null").withColumnRenamed("sample_id", "page"))
    tier1 = found.withColumn("_to", absolute(F.col("width"), F.col("height"), s.route)).withColumn("kind", F.col("_to.kind")).withColumn("reason", F.col("_to.reason")).drop("_to")
    # the dense gate compares with the page's own area: scale areas so that one constant serves all pages
    norm = tier1.withColumn("_area", F.col("pixel_area")).withColumn("pixel_area", F.col("pixel_area") * 1e6 / (F.col("width") * F.col("height")))
    routed = route_relative(norm, 1_000_000, s.route).withColumn("pixel_area", F.col("_area")).drop("_area")
    back = 1 / F.col("scale")
    b = scaled(Box.of(), back)
    keep = F.col("scale") == 1
    cols = [F.when(keep, F.col(n)).otherwise(c).alias(n) for n, c in zip("xywh", (b.x, b.y, b.w, b.h), strict=True)]
    return routed.select(F.col("page").alias("sample_id"), "id", *cols, (F.col("cx") * back).alias("cx"), (F.col("cy") * back).alias("cy"), "pixel_area", "fill_ratio", "kind", "reason", "scale", "polarity_inverted", "recovered")


def page_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page, rank, id, pixel_area of each page's inverted candidates; batches of (page, array of (id, x, y, w, h, pixel_area))."""
    for batch in batches:
        rows = []
        for page, found in zip(*batch.columns, strict=True):  # one page at a time as Python objects: a batch holds thousands
            good = kernels.inverted_candidates([*zip(*(c.to_pylist() for c in found.values.flatten()), strict=True)], 1_000_000)
            rows += [(page.as_py(), k + 1, c[0], c[5]) for k, c in enumerate(good)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["page", "rank", "id", "pixel_area"])


def per_image(rasters: DataFrame, f: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows that a kernel makes of each raster of (image, w, v array): image and the columns of schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [_TYPES[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cols = [], [[] for _ in names]
            for key, a in arrays(batch):
                for row in f(a):
                    keys.append(key)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["image", *names])

    return rasters.select(F.col("image").cast("long"), "w", "v").mapInArrow(run, f"image long, {schema}")


def arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Each raster of a batch (image, w, v) as a view of the batch's one buffer of pixels."""
    flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
    ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
    for key, w, start, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [0, *ends[:-1]], ends, strict=True):
        yield key, flat[start:end].reshape(-1, w)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def as_pixels(rasters: DataFrame) -> DataFrame:
    """image, y, x, v: a row a pixel."""
    rows = rasters.select("image", "w", F.posexplode("v").alias("i", "v"))
    return rows.select("image", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), "v")


def otsu_thresholds(pixels: DataFrame) -> DataFrame:
    """image, threshold, dark_fraction: by running sums over an image's distinct values; of equal splits the lowest value."""
    hist = pixels.groupBy("image", "v").agg(F.count("*").alias("c"))
    upto, everything = W.partitionBy("image").orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("image")
    n, s_all = F.sum("c").over(everything), F.sum(F.col("c") * F.col("v")).over(everything)
    w, s = F.sum("c").over(upto), F.sum(F.col("c") * F.col("v")).over(upto)
    lean = (s * n - w * s_all).cast("double")
    between = F.when(w < n, lean * lean / (w * (n - w)).cast("double")).otherwise(F.lit(-1.0))
    split = hist.select("image", "v", between.alias("b"), (w / n).alias("dark"))
    best = F.max(F.struct("b", (-F.col("v")).alias("m"), "dark")).alias("best")
    return split.groupBy("image").agg(best).select("image", (-F.col("best.m")).cast("int").alias("threshold"), F.col("best.dark").alias("dark_fraction"))


def polarity(pixels: DataFrame) -> DataFrame:
    return otsu_thresholds(pixels).select("image", "threshold", (F.col("dark_fraction") > 0.5).alias("inverted"))


def otsu_binary(pixels: DataFrame) -> DataFrame:
    """image, y, x, v with ink 255."""
    t = otsu_thresholds(pixels).withColumnRenamed("image", "_i")
    return pixels.join(t, F.col("image") == F.col("_i")).select("image", "y", "x", F.when(F.col("v") <= F.col("threshold"), 255).otherwise(0).alias("v"))


def connected_components(binary: DataFrame, connectivity: int = 8) -> DataFrame:
    """image, x, y, w, h, pixel_area of every component of rasters."""
    return per_image(binary, lambda a: [c[1:6] for c in kernels.components(a, connectivity)], "x int, y int, w int, h int, pixel_area int")


def label_maps(binary: DataFrame, connectivity: int = 8) -> DataFrame:
    """Rasters of labels: 0 for ground, then 1.. in order of the components' first pixels."""
    return mapped(binary, lambda a: kernels.labels(a, connectivity)[0])


def mapped(rasters: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rasters (image, w, v) behind a kernel: an array an image on both sides. The shape may change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(a) for _, a in arrays(batch)]
            ends = np.cumsum([0, *(m.size for m in made)])
            flat = np.concatenate([np.zeros(0, np.int32), *(m.ravel() for m in made)]).astype(np.int32)
            cols = [batch.column(0), pa.array([m.shape[1] for m in made], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, ["image", "w", "v"])

    return rasters.select(F.col("image").cast("long"), "w", "v").mapInArrow(run, "image long, w int, v array<int>")


def run_timed(images: DataFrame, s: Settings = Settings(), repeats: int = 3, warmup: int = 1) -> DataFrame:
    """document, repeat, stage, ms: each image goes through the kernels repeats times, behind warmup runs that don't count.

    Routing runs as a plan over all pages and has no time of a page. Relations of one run must not be compared across clusters of unlike machines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
                a = a[..., 0] if r["n_channels"] == 1 else a
                for k in range(-warmup, max(1, repeats)):
                    took = kernels.traced_page(a, s)[3]
                    rows += [(r["sample_id"], k, stage, ms) for stage, ms in took.items() if k >= 0]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.float64()), strict=True)], ["document", "repeat", "stage", "ms"])

    return images.select("sample_id", "height", "width", "n_channels", "data").mapInArrow(run, "document string, repeat int, stage string, ms double")


def debug_images(images: DataFrame, s: Settings = Settings()) -> DataFrame:
    """sample_id, stage (gray or binary), height, width, n_channels, data: what the kernels saw, in the processing frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
                seen = kernels.traced_page(a[..., 0] if r["n_channels"] == 1 else a, s)[2]
                cols = [[r["sample_id"]] * 2, list(seen), *([v.shape[k] for v in seen.values()] for k in (0, 1)), [1, 1], [v.tobytes() for v in seen.values()]]
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["sample_id", "stage", "height", "width", "n_channels", "data"])

    return images.select("sample_id", "height", "width", "n_channels", "data").mapInArrow(run, "sample_id string, stage string, height int, width int, n_channels int, data binary")


def page_results(routed: DataFrame) -> DataFrame:
    """Per page: scale, polarity and counts of all kinds."""
    return routed.groupBy("sample_id").agg(F.max("scale").alias("scale"), F.bool_or("polarity_inverted").alias("polarity_inverted"), F.max("recovered").alias("recovered"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
