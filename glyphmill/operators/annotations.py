"""Annotation formats to one sample schema, validation, upserts and manifests, as array expressions on whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import from_corners, from_points, let
from ..functions.schemas import BOX, BOXES, CHAR, SAMPLE

#: Fields of a cheque and the types they map to.
CHEQUE_FIELDS = {"date": "dob", "amount": "account", "ifsc": "account", "acno": "account", "sign": "signature", "name": "name"}
#: Label names of identity documents.
FACE_NAMES, DOCUMENT_NAMES = ("face", "photo", "portrait"), ("document", "doc", "card")
ENTITY_TYPES = {"company": "name", "address": "address", "total": "account"}
#: Samples expected of each source.
EXPECTED = {"synth": 150, "sroie": 40, "funsd": 25, "cheque": 30}
SHARES = {"sroie": 0.16, "funsd": 0.10, "cheque": 0.10}


def gt_box(bbox: Column, text: Column | None = None, kind: Column | str = "") -> Column:
    return F.struct(bbox.cast("array<int>").alias("bbox"), F.coalesce(text if text is not None else F.lit(""), F.lit("")).alias("text"), F.coalesce(F.lit(kind) if isinstance(kind, str) else kind, F.lit("")).alias("type")).cast(BOX)


def no_boxes() -> Column:
    return F.array().cast("array<struct<bbox:array<int>,text:string,type:string>>")


def blank(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) == 0


def receipt_lines(words: Column, bboxes: Column) -> Column:
    """Lines of a receipt: words with their boxes; blank ones and empty boxes drop out. Lengths must agree."""
    zipped = F.transform(F.arrays_zip(words.alias("t"), bboxes.alias("b")), lambda z: gt_box(from_corners(z["b"]), z["t"]))
    good = F.filter(zipped, lambda g: g["bbox"].isNotNull() & ~blank(g["text"]))
    return F.when(F.size(words) == F.size(bboxes), good).otherwise(F.raise_error(F.lit("words and boxes differ in number")).cast(no_boxes_type()))


def no_boxes_type() -> str:
    return "array<struct<bbox:array<int>,text:string,type:string>>"


def entity_boxes(lines: Column, entities: dict[str, Column]) -> Column:
    """For each entity the first line that contains its value; entities without one drop out."""
    def first(field: str, value: Column) -> Column:
        holds = lambda v: lambda g: F.contains(g["text"], v)
        box = lambda v: let(F.get(F.filter(lines, holds(v)), F.lit(0)), lambda g: F.when(g.isNotNull() & ~blank(v), gt_box(g["bbox"], v, ENTITY_TYPES.get(field, field))))
        return let(value, box)

    return F.filter(F.array(*(first(k, v) for k, v in entities.items())), lambda g: g.isNotNull())


def sample(sample_id: Column, source: str, capture: Column | str, dpi: int, text: Column, lines: Column, words: Column, chars: Column, pii: Column, nontext: Column, meta: dict[str, str | Column]) -> list[Column]:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    pairs = [x for k, v in meta.items() for x in (F.lit(k), lit(v))]
    return [
        sample_id.alias("sample_id"), F.lit(source).alias("source"), lit(capture).alias("capture"), F.lit("latin").alias("script"), F.lit(dpi).alias("dpi"), text.alias("text"),
        lines.alias("lines"), words.alias("words"), chars.cast("array<struct<bbox:array<int>,char:string>>").alias("chars"), pii.alias("pii"), nontext.alias("regions_nontext"), F.create_map(*pairs).alias("meta"),
    ]


def from_receipts(rows: DataFrame) -> DataFrame:
    def both(lines: Column) -> Column:
        pii = entity_boxes(lines, {k: F.col(f"entities.{k}") for k in ENTITY_TYPES})
        return F.struct(lines.alias("lines"), pii.alias("pii"), F.array_join(F.transform(lines, lambda g: g["text"]), "\n").alias("text"))

    d = rows.withColumn("_b", let(receipt_lines(F.col("words"), F.col("bboxes")), both))
    return d.select(*sample(F.concat(F.lit("sroie_"), "key"), "sroie", "scan", 200, F.col("_b.text"), F.col("_b.lines"), no_boxes(), F.lit(None), F.col("_b.pii"), no_boxes(), {"template": "receipt", "gt_complete": "true"}))


def form_lines(form: Column) -> Column:
    return F.filter(F.transform(form, lambda e: gt_box(from_corners(e["box"]), e["text"], e["label"])), lambda g: g["bbox"].isNotNull())


def form_words(form: Column) -> Column:
    words = F.flatten(F.transform(form, lambda e: F.coalesce(e["words"], F.array().cast("array<struct<box:array<double>,text:string>>"))))
    return F.filter(F.transform(words, lambda w: gt_box(from_corners(w["box"]), w["text"])), lambda g: g["bbox"].isNotNull() & ~blank(g["text"]))


def from_forms(rows: DataFrame) -> DataFrame:
    """rows: stem, form."""
    d = rows.withColumn("_lines", form_lines(F.col("form")))
    text = F.array_join(F.filter(F.transform("_lines", lambda g: g["text"]), lambda t: F.length(t) > 0), "\n")
    return d.select(*sample(F.concat(F.lit("funsd_"), "stem"), "funsd", "scan", 200, text, F.col("_lines"), form_words(F.col("form")), F.lit(None), no_boxes(), no_boxes(), {"template": "form", "gt_complete": "true"}))


def field_boxes(fields: dict[str, Column]) -> Column:
    """Boxes of the fields that have one, their type by the field; corners are cut to whole numbers."""
    corners = lambda c: let(F.array(c["xmin"], c["ymin"], c["xmax"], c["ymax"]), lambda v: from_corners(v, truncate=True))
    return F.filter(F.array(*(gt_box(corners(c), None, CHEQUE_FIELDS[f]) for f, c in fields.items())), lambda g: g["bbox"].isNotNull())


def from_cheques(rows: DataFrame) -> DataFrame:
    pii = field_boxes({f: F.col(f) for f in CHEQUE_FIELDS})
    nontext = F.filter(pii, lambda g: g["type"] == "signature")
    return rows.select(*sample(F.concat(F.lit("cheque_"), "image_id"), "cheque", "scan", 300, F.lit(""), no_boxes(), no_boxes(), F.lit(None), pii, nontext, {"template": "cheque", "gt_complete": "false", "bank": F.coalesce("bank", F.lit(""))}))


def region_box(shape: Column) -> Column:
    """A polygon's box, else the rectangle, else null."""
    b = from_points(shape["all_points_x"], shape["all_points_y"])
    polygon = F.when((F.size(shape["all_points_x"]) > 0) & (F.size(shape["all_points_y"]) > 0), F.array(b.x, b.y, b.w, b.h))
    rect = F.array(*(shape[n].cast("int") for n in ("x", "y", "width", "height")))
    return F.coalesce(polygon, F.when(shape["x"].isNotNull() & shape["y"].isNotNull() & shape["width"].isNotNull() & shape["height"].isNotNull(), rect))


def region_role(attributes: Column) -> Column:
    """face, frame, name or passport, by the label's name."""
    name = F.lower(F.coalesce(F.nullif(attributes["field_name"], F.lit("")), attributes["name"], F.lit("")))
    return F.when(name.isin(*FACE_NAMES), "face").when(name.isin(*DOCUMENT_NAMES), "frame").when(F.contains(name, F.lit("name")), "name").otherwise("passport")


def labelled_regions(regions: Column) -> Column:
    """array<struct<bbox, text, type>> with the role as type; regions without a box drop out."""
    made = F.transform(regions, lambda r: gt_box(region_box(r["shape_attributes"]), r["region_attributes"]["value"], region_role(r["region_attributes"])))
    return F.filter(made, lambda g: g["bbox"].isNotNull())


def from_identity(rows: DataFrame) -> DataFrame:
    """rows: path, stem, regions, _via_img_metadata. Neither layout present is an error."""
    nested = F.map_values("_via_img_metadata")
    first = F.get(F.filter(nested, lambda e: e["regions"].isNotNull()), F.lit(0))["regions"]
    missing = F.raise_error(F.concat(F.lit("unknown annotation layout: "), "path"))
    d = rows.withColumn("_regions", F.coalesce("regions", first)).where(F.when(F.col("_regions").isNull(), missing.cast("boolean")).otherwise(True))
    d = d.withColumn("_all", labelled_regions(F.col("_regions")))
    pii = F.filter("_all", lambda g: g["type"] != "frame")
    nontext = F.transform(F.filter("_all", lambda g: g["type"].isin("face", "frame")), lambda g: gt_box(g["bbox"], None, F.when(g["type"] == "face", "photo").otherwise("frame")))
    text = F.array_join(F.filter(F.transform(F.filter("_all", lambda g: g["type"].isin("name", "passport")), lambda g: g["text"]), lambda t: t != ""), "\n")
    capture = F.when(F.contains(F.lower("path"), F.lit("photo")), "photo").otherwise("scan")
    return d.select(*sample(F.concat(F.lit("midv_"), "stem"), "midv", capture, 150, text, no_boxes(), no_boxes(), F.lit(None), pii, nontext, {"template": "identity", "gt_complete": "false"}))


def char_or_word(rows: DataFrame) -> DataFrame:
    """page, kind (char or word), text, bbox: a text of one character is a character."""
    b = from_points(F.transform("box", lambda p: F.get(p, F.lit(0))), F.transform("box", lambda p: F.get(p, F.lit(1))))
    return rows.where(~blank(F.col("text"))).select("page", F.when(F.length("text") == 1, "char").otherwise("word").alias("kind"), "text", F.array(b.x, b.y, b.w, b.h).alias("bbox"))


def from_char_boxes(rows: DataFrame) -> DataFrame:
    """rows: page, text, box, exported from the original archive; one sample a page."""
    split = char_or_word(rows)
    words = F.sort_array(F.collect_list(F.when(F.col("kind") == "word", gt_box(F.col("bbox"), F.col("text")))))
    chars = F.sort_array(F.collect_list(F.when(F.col("kind") == "char", F.struct(F.col("bbox").cast("array<int>").alias("bbox"), F.col("text").alias("char")).cast(CHAR))))
    per = split.groupBy("page").agg(words.alias("_words"), chars.alias("_chars"))
    return per.select(*sample(F.concat(F.lit("ddi100_"), "page"), "ddi100", "scan", 300, F.lit(""), no_boxes(), F.col("_words"), F.col("_chars"), no_boxes(), no_boxes(), {"template": "page", "gt_complete": "true"}))


def has_truth(row: str = "") -> Column:
    n = lambda c: F.coalesce(F.size(F.col(row + c)), F.lit(0))
    return (n("chars") > 0) | (n("words") > 0) | (n("lines") > 0) | (n("regions_nontext") > 0)


def validated(samples: DataFrame) -> DataFrame:
    """Fails on the first sample without any ground truth."""
    bad = F.raise_error(F.concat(F.lit("no ground truth in "), F.coalesce("sample_id", F.lit("?")))).cast("boolean")
    return samples.where(F.when(has_truth(), True).otherwise(bad))


def to_json(samples: DataFrame) -> DataFrame:
    """sample_id, json. Null chars stay apart from empty ones."""
    return samples.select("sample_id", F.to_json(F.struct(*samples.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Samples from their JSON; missing keys get the defaults, chars stay null."""
    s = F.from_json("json", SAMPLE)
    d = rows.select(s.alias("s"))
    boxes = lambda c: F.transform(F.coalesce(F.col(f"s.{c}"), no_boxes()), lambda g: gt_box(g["bbox"], g["text"], g["type"]))
    return d.select(
        "s.sample_id", "s.source", "s.capture", "s.script", F.coalesce("s.dpi", F.lit(0)).alias("dpi"), F.coalesce("s.text", F.lit("")).alias("text"),
        *(boxes(c).alias(c) for c in ("lines", "words")), "s.chars", *(boxes(c).alias(c) for c in ("pii", "regions_nontext")), F.coalesce("s.meta", F.create_map().cast("map<string,string>")).alias("meta"),
    )


def manifest(samples: DataFrame, images: DataFrame) -> DataFrame:
    """One row a sample: keys, has_char_gt, n_words and whether its image is there. images: sample_id."""
    there = images.select(F.col("sample_id").alias("_id")).distinct().withColumn("image_present", F.lit(True))
    joined = samples.join(there, F.col("sample_id") == F.col("_id"), "left")
    return joined.select("sample_id", "source", "capture", "script", "dpi", F.coalesce(F.size("chars") > 0, F.lit(False)).alias("has_char_gt"), F.size("words").alias("n_words"), F.coalesce("image_present", F.lit(False)).alias("image_present"))


def source_status(counts: DataFrame, expected: DataFrame, forced: bool = False) -> DataFrame:
    """source, n_gt, n_images, want, status, needed. counts: source, n_gt, n_images; expected: source, want."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = expected.join(counts, "source", "left").select("source", "want", n("n_gt").alias("n_gt"), n("n_images").alias("n_images"))
    status = (
        F.when(F.lit(forced), "forced re-fetch")
        .when((F.col("n_images") >= F.col("want")) & (F.col("n_gt") >= F.col("want")), "ok")
        .when((F.col("n_gt") > 0) & (F.col("n_images") == 0), "ground truth but no images")
        .when(F.col("n_gt") > 0, F.concat(F.lit("incomplete ("), F.col("n_images").cast("string"), F.lit("/"), F.col("want").cast("string"), F.lit(")")))
        .otherwise("missing")
    )
    return d.withColumn("status", status).withColumn("needed", F.col("status") != "ok")


def image_by_stem(annotations: DataFrame, images: DataFrame, extensions: tuple[str, ...] = (".jpg", ".png", ".tif")) -> DataFrame:
    """stem, image: of the images with an annotation's stem the one whose extension comes first; annotations without one drop out."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    i = images.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("_stem"), "path", rank.alias("rank")).where("rank > 0")
    return annotations.join(i, F.col("stem") == F.col("_stem")).groupBy("stem").agg(F.min_by("path", F.struct("rank", "path")).alias("image"))


def path_parts(path: Column) -> list[Column]:
    """stem, parent and capture of a path: a photo where the path says so in either case, else a scan."""
    return [
        F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract(path, r"([^/]+)/[^/]*$", 1).alias("parent"),
        F.when(F.contains(F.lower(path), F.lit("photo")), "photo").otherwise("scan").alias("capture"),
    ]


def apply_reviews(samples: DataFrame, proposals: DataFrame, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples with reviewed words in place of their own, and proposals that match no sample. Proposals without words change nothing.

    Of several proposals for one sample the one with the most words counts, of those the one whose form sorts last.
    """
    one = proposals.groupBy("sample_id").agg(F.max_by(F.struct("words", "bootstrapped_with"), F.struct(F.size("words"), F.to_json(F.struct("words", "bootstrapped_with")))).alias("best")).select("sample_id", "best.*")
    p = one.select(F.col("sample_id").alias("_id"), F.filter(F.transform("words", lambda w: gt_box(w["bbox"], w["text"])), lambda g: ~blank(g["text"])).alias("_words"), "bootstrapped_with")
    unmatched = p.join(samples.select("sample_id"), F.col("_id") == F.col("sample_id"), "left_anti").select(F.col("_id").alias("sample_id"))
    use = F.coalesce(F.size("_words") > 0, F.lit(False)) & (F.lit(True) if source is None else F.col("source") == source)
    d = samples.join(p, F.col("sample_id") == F.col("_id"), "left").withColumn("_use", use)
    new = {"words": F.col("_words"), "text": F.array_join(F.transform("_words", lambda g: g["text"]), " "), "meta": F.map_concat(F.map_filter("meta", lambda k, v: k != "reviewed_from"), F.create_map(F.lit("reviewed_from"), F.coalesce("bootstrapped_with", F.lit(""))))}
    out = d.select(*(F.when(F.col("_use"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in samples.columns))
    return out, unmatched


def proposals_todo(samples: DataFrame, images: DataFrame, existing: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """Samples of a source that have an image and no proposal yet."""
    d = samples.where(F.col("source") == source).join(images.select("sample_id").distinct(), "sample_id", "left_semi").join(existing.select("sample_id").distinct(), "sample_id", "left_anti")
    return d.orderBy("sample_id").limit(limit) if limit else d


def gathered(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def synth_count(total: int, shares: dict[str, float] | None = None) -> int:
    return max(1, round(total * (1.0 - sum((SHARES if shares is None else shares).values()))))


def truth_tables(samples: DataFrame) -> dict[str, DataFrame]:
    """Each array of boxes as rows (sample_id, pos, x, y, w, h, text, type), and chars."""
    at = lambda i: F.get("b.bbox", F.lit(i))
    out = {}
    for c in (*BOXES, "chars"):
        rows = samples.select("sample_id", F.posexplode(c).alias("pos", "b"))
        rest = [F.col("b.char").alias("char")] if c == "chars" else [F.col("b.text").alias("text"), F.col("b.type").alias("type")]
        out[c] = rows.select("sample_id", "pos", *(at(i).alias(n) for i, n in enumerate("xywh")), *rest)
    return out
