"""Schemas of samples and their JSON form."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType()), T.StructField("type", T.StringType())])
CHAR = T.StructType([T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("char", T.StringType())])
SAMPLE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("capture", T.StringType()),
        T.StructField("script", T.StringType()),
        T.StructField("dpi", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("lines", T.ArrayType(BOX)),
        T.StructField("words", T.ArrayType(BOX)),
        T.StructField("chars", T.ArrayType(CHAR)),
        T.StructField("pii", T.ArrayType(BOX)),
        T.StructField("regions_nontext", T.ArrayType(BOX)),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)
BOXES = ("lines", "words", "pii", "regions_nontext")
RECEIPT = "key string, words array<string>, bboxes array<array<double>>, entities struct<company: string, address: string, total: string>"
FORM = "form array<struct<box: array<double>, text: string, label: string, words: array<struct<box: array<double>, text: string>>>>"
CORNERS = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
CHEQUE = "image_id string, bank string, " + ", ".join(f"{f} {CORNERS}" for f in ("date", "amount", "ifsc", "acno", "sign", "name"))
REGION = "struct<shape_attributes: struct<all_points_x: array<double>, all_points_y: array<double>, x: double, y: double, width: double, height: double>, region_attributes: struct<field_name: string, name: string, value: string>>"
IDENTITY = f"regions array<{REGION}>, _via_img_metadata map<string, struct<regions: array<{REGION}>>>"
CHAR_BOXES = "text string, box array<array<double>>"
PROPOSAL = "sample_id string, bootstrapped_with string, words array<struct<bbox: array<int>, text: string>>"
