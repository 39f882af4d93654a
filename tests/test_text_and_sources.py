import json

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import annotations as A
from glyphmill.operators import synth
from glyphmill.sources import store as S
from glyphmill.streaming.latency import windowed_latency


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("cents", "words"),
    [
        (0, "ZERO DOLLARS ONLY"), (100, "ONE DOLLARS ONLY"), (1942, "NINETEEN DOLLARS AND FORTY TWO CENTS ONLY"), (10000, "ONE HUNDRED DOLLARS ONLY"), (12345678, "ONE HUNDRED AND TWENTY THREE THOUSAND FOUR HUNDRED AND FIFTY SIX DOLLARS AND SEVENTY EIGHT CENTS ONLY"),
        (100000000 - 1, "NINE HUNDRED AND NINETY NINE THOUSAND NINE HUNDRED AND NINETY NINE DOLLARS AND NINETY NINE CENTS ONLY"), (200000, "TWO THOUSAND DOLLARS ONLY"),
    ],
)
def test_amounts(spark, cents, words):
    assert one(spark, X.amount_in_words(F.lit(cents)))[0] == words


@pytest.mark.parametrize(("number", "valid"), [("S0000001I", True), ("S0000001J", False), ("X0000001I", False), ("S123", False), ("T0000000G", True)])
def test_identity_numbers(spark, number, valid):
    assert one(spark, X.nric_valid(F.lit(number)))[0] is valid


def test_machine_readable_lines(spark):
    d = F.lit("2001-02-03").cast("date")
    a, b = one(spark, *X.mrz_lines(F.lit("O'Neil"), F.lit("Ann"), F.lit("K1"), d, d, F.lit("F"), F.lit("12345")))
    assert (a, b) == ("P<SGPO<NEIL<<ANN".ljust(44, "<"), "K1<<<<<<<1SGP0102032F0102033" + "<" * 14 + "45")


def test_tokens(spark):
    assert [tuple(t) for t in one(spark, X.tokens(F.lit("a  bc d")))[0]] == [("a", 0), ("bc", 3), ("d", 6)]


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(x) for x in lines), encoding="utf-8")
    return str(path)


def test_receipts(spark, tmp_path):
    rows = [{"key": "r1", "words": ["ACME LTD", " ", "TOTAL 5.00", "bad"], "bboxes": [[0, 0, 10, 5], [0, 5, 3, 9], [1.5, 10, 21, 20], [5, 5, 5, 9]], "entities": {"company": "ACME", "address": "nowhere", "total": "5.00"}}]
    r = S.read_receipts(spark, write(tmp_path / "rows.jsonl", rows)).first()
    assert (r.sample_id, r.source, r.chars, r.text) == ("sroie_r1", "sroie", None, "ACME LTD\nTOTAL 5.00")
    assert [(g.bbox, g.text) for g in r.lines] == [([0, 0, 10, 5], "ACME LTD"), ([2, 10, 19, 10], "TOTAL 5.00")]
    assert [(g.text, g.type, g.bbox) for g in r.pii] == [("ACME", "name", [0, 0, 10, 5]), ("5.00", "account", [2, 10, 19, 10])]
    bad = write(tmp_path / "bad.jsonl", [{"key": "x", "words": ["a"], "bboxes": [], "entities": None}])
    with pytest.raises(Exception, match="differ in number"):
        S.read_receipts(spark, bad).collect()


def test_forms(spark, tmp_path):
    form = {"form": [{"box": [0, 0, 9, 9], "text": "Name", "label": "question", "words": [{"box": [0, 0, 4, 9], "text": "Na"}, {"box": [1, 1, 1, 1], "text": "x"}, {"box": [0, 0, 2, 2], "text": " "}]}, {"box": [3, 3, 3, 3], "text": "", "label": "other", "words": []}]}
    r = S.read_forms(spark, write(tmp_path / "f1.json", [form])).first()
    assert (r.sample_id, r.text, len(r.lines), [w.text for w in r.words], r.lines[0].type) == ("funsd_f1", "Name", 1, ["Na"], "question")


def test_cheques(spark, tmp_path):
    b = {"xmin": 1.9, "ymin": 2, "xmax": 11, "ymax": 12}
    r = S.read_cheques(spark, write(tmp_path / "c.jsonl", [{"image_id": "7", "bank": "B", "date": b, "sign": b, "name": None, "amount": b | {"xmax": 1}}])).first()
    assert [(g.type, g.bbox) for g in r.pii] == [("dob", [1, 2, 10, 10]), ("signature", [1, 2, 10, 10])] and [g.type for g in r.regions_nontext] == ["signature"]
    with pytest.raises(Exception, match="no ground truth"):
        S.read_cheques(spark, write(tmp_path / "e.jsonl", [{"image_id": "8", "bank": "B"}])).collect()


def test_identity(spark, tmp_path):
    region = lambda name, value="": {"shape_attributes": {"all_points_x": [1, 9], "all_points_y": [2, 8]}, "region_attributes": {"field_name": name, "value": value}}
    write(tmp_path / "photo" / "a.json", [{"regions": [region("Face"), region("doc"), region("surname", "LEE"), region("number", "K1"), {"shape_attributes": {}, "region_attributes": {}}]}])
    write(tmp_path / "photo" / "b.json", [{"_via_img_metadata": {"x": {"regions": [region("face")]}}}])
    a, b = S.read_identity(spark, str(tmp_path / "photo")).orderBy("sample_id").collect()
    assert (a.sample_id, a.capture, a.text) == ("midv_a", "photo", "LEE\nK1")
    assert [g.type for g in a.pii] == ["face", "name", "passport"] and [g.type for g in a.regions_nontext] == ["photo", "frame"]
    assert [g.type for g in b.pii] == ["face"]
    write(tmp_path / "odd" / "c.json", [{"other": 1}])
    with pytest.raises(Exception, match="unknown annotation layout"):
        S.read_identity(spark, str(tmp_path / "odd")).collect()


def test_char_boxes(spark, tmp_path):
    box = [[0, 0], [4, 0], [4, 6], [0, 6]]
    r = S.read_char_boxes(spark, write(tmp_path / "p1.jsonl", [{"text": "a", "box": box}, {"text": "word", "box": box}, {"text": " ", "box": box}])).first()
    assert [c.char for c in r.chars] == ["a"] and [w.text for w in r.words] == ["word"] and r.words[0].bbox == [0, 0, 4, 6]


def sample_rows(spark):
    d = spark.createDataFrame([("s1", True), ("s2", False)], "id string, c boolean")
    words = F.array(A.gt_box(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), F.lit("hi")))
    chars = F.when(F.col("c"), F.array(F.struct(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("bbox"), F.lit("h").alias("char"))))
    return d.select(*A.sample(F.col("id"), "synth", "scan", 100, F.lit("hi"), A.no_boxes(), words, chars, A.no_boxes(), A.no_boxes(), {"template": "form"}))


def test_store(spark, tmp_path):
    st = S.Store(spark, str(tmp_path))
    assert st.read().count() == 0
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "s1.png").write_bytes(S.png(bytes(range(12)), 2, 2, 3))
    st.write(sample_rows(spark))
    a, b = st.read().collect()
    assert (a.sample_id, a.words[0].text, a.chars[0].char, b.chars, a.meta) == ("s1", "hi", "h", None, {"template": "form"})
    got = [(r.sample_id, r.has_char_gt, r.n_words, r.image_present) for r in st.manifest().orderBy("sample_id").collect()]
    assert got == [("s1", True, 1, True), ("s2", False, 1, False)]
    st.write_manifest()
    (tmp_path / "gt" / "s3.json").write_text(json.dumps({"sample_id": "s3", "dpi": 7}, indent=1))
    assert [(r.sample_id, r.dpi) for r in st.read().collect()] == [("s1", 100), ("s2", 100), ("s3", 7)]
    image = S.images(spark, f"{tmp_path}/images").first()
    assert (image.sample_id, image.height, image.width, bytes(image.data)) == ("s1", 2, 2, bytes(range(12)))
    (tmp_path / "images" / "broken.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="undecodable"):
        S.images(spark, f"{tmp_path}/images").collect()


def test_json_defaults(spark):
    r = A.from_json(spark.createDataFrame([('{"sample_id": "x"}',), ('{"sample_id": "y", "chars": []}',)], "json string")).collect()
    assert [(x.dpi, x.text, x.words, x.chars, x.meta) for x in r] == [(0, "", [], None, {}), (0, "", [], [], {})]


def test_reviews(spark):
    p = spark.createDataFrame([("s1", "e", [([5, 5, 5, 5], "new"), ([1, 1, 1, 1], " ")]), ("s2", "e", []), ("s9", "e", [])], "sample_id string, bootstrapped_with string, words array<struct<bbox:array<int>,text:string>>")
    out, unmatched = A.apply_reviews(sample_rows(spark), p)
    a, b = out.orderBy("sample_id").collect()
    assert (a.text, [w.text for w in a.words], b.text) == ("new", ["new"], "hi") and [r.sample_id for r in unmatched.collect()] == ["s9"]
    todo = A.proposals_todo(sample_rows(spark), sample_rows(spark).where("sample_id = 's1'"), p.where("sample_id = 's2'"), "synth")
    assert [r.sample_id for r in todo.collect()] == ["s1"]


def test_plan_is_repeatable(spark):
    a, b = (sorted(tuple(r) for r in synth.plan(spark, 30, 3).collect()) for _ in range(2))
    assert a == b and len(a) == 30
    assert {s[0] for s in synth.available(synth.STRATA, {"thai"})} == {s[0] for s in synth.STRATA} - {"plain_thai"}
    assert A.synth_count(250) == 160 and A.synth_count(250, {}) == 250


def test_degraded_layout(spark):
    lines = spark.createDataFrame([("s", 0, "ab c"), ("s", 1, "d")], "sample_id string, line int, text string")
    boxes = synth.layout(lines)
    assert [(r.ch, r.x, r.y) for r in boxes.orderBy("line", "pos").collect()] == [("a", 20, 20), ("b", 34, 20), ("c", 62, 20), ("d", 20, 50)]
    still = spark.createDataFrame([("s", 0.0, 1.0)], "sample_id string, degrees double, scale double")
    moved = synth.degrade_boxes(boxes, synth.rotation_matrices(still, 200, 100), 200, 100)
    assert sorted((r.x, r.y, r.w, r.h) for r in moved.collect()) == sorted((r.x, r.y, r.w, r.h) for r in boxes.collect())
    half = synth.degrade_boxes(boxes, synth.rotation_matrices(still.withColumn("scale", F.lit(0.5)), 200, 100), 200, 100)
    assert sorted((r.w, r.h) for r in half.collect()) == [(5, 10)] * 4


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "a", float(i)) for i in range(9)], "event_id int, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(f"{tmp_path}/in")
    q = windowed_latency(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("lat").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.start), r.stage, r.n, r["mean"], r["max"])
    assert sorted(map(key, spark.table("lat").collect())) == sorted(map(key, windowed_latency(rows).collect()))
