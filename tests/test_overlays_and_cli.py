import json

import numpy as np
import pytest

from glyphmill import cli
from glyphmill.operators import overlays as O
from glyphmill.sources.store import images, png


def test_draw():
    a = O.draw(np.full((20, 30), 255, np.uint8), [(5, 5, 10, 8, "text"), (25, 15, 50, 50, "rule"), (0, 0, 3, 3, "noise")], ("text", "rule"))
    assert tuple(a[5, 5]) == O.COLOURS["text"] and tuple(a[12, 14]) == O.COLOURS["text"] and tuple(a[8, 8]) == (255, 255, 255)
    assert tuple(a[15, 29]) == O.COLOURS["rule"] and tuple(a[0, 0]) == (255, 255, 255)
    assert O.side_by_side(a, O.binary_preview(np.zeros((5, 5), np.uint8))).shape == (20, 43, 3)


def test_overlays(spark, tmp_path):
    pages = spark.createDataFrame([("a", 10, 10, 1, bytearray(b"\xff" * 100)), ("b", 4, 4, 3, bytearray(48))], "sample_id string, height int, width int, n_channels int, data binary")
    comps = spark.createDataFrame([("a", 2, 2, 4, 4, "blob")], "sample_id string, x int, y int, w int, h int, kind string")
    for r in O.overlays(pages, comps).collect():
        (tmp_path / f"{r.sample_id}.png").write_bytes(bytes(r.png))
    got = {r.sample_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in images(spark, str(tmp_path)).collect()}
    assert tuple(got["a"][2, 2]) == O.COLOURS["blob"] and tuple(got["a"][3, 3]) == (255, 255, 255) and got["b"].shape == (4, 4, 3)
    assert [r.sample_id for r in O.sampled(pages, 1, 3).collect()] == [r.sample_id for r in O.sampled(pages, 1, 3).collect()]


def test_report_of_a_store(spark, tmp_path):
    page = np.full((200, 300), 255, np.uint8)
    glyphs = [(10 + 20 * i, 100, 8, 14) for i in range(13)]
    for x, y, w, h in glyphs:
        page[y : y + h, x : x + w] = 0
    (tmp_path / "gt").mkdir()
    (tmp_path / "images").mkdir()
    for sid in ("synth_1", "synth_2"):
        sample = {"sample_id": sid, "source": "synth", "capture": "scan", "script": "latin", "dpi": 120, "chars": [{"bbox": list(g), "char": "x"} for g in glyphs], "words": [{"bbox": [10, 100, 248, 14], "text": "x"}], "meta": {"template": "form"}}
        (tmp_path / "gt" / f"{sid}.json").write_text(json.dumps(sample, indent=1))
    (tmp_path / "images" / "synth_1.png").write_bytes(png(page.tobytes(), 200, 300, 1))
    settings = cli.Settings.from_dict({"preprocess": {"upscale": False, "normalize_illumination": False}, "binarize": {"method": "otsu"}})
    text = cli.evaluate(spark, str(tmp_path), settings, cli.RunFilter(sources=("synth",)), repeats=2, run_id="r1")
    assert "| character isolation recall | 100.0% |" in text and "- skipped for want of an image: 1" in text and "### Latency: scan" in text
    assert all(f"| {stage} |" in text for stage in ("preprocess", "binarize", "ccl", "total"))
    assert cli.kept_report(spark, str(tmp_path), "r1").strip() == text.strip()
    kept = {t: spark.read.json(f"{tmp_path}/results/r1/{t}").collect() for t in ("chars", "timings", "skipped")}
    assert [(r.sample_id, r.isolated) for r in kept["chars"]] == [("synth_1", 13)] and {r.stage for r in kept["timings"]} == {"preprocess", "binarize", "ccl", "total"} and kept["skipped"][0].sample_id == "synth_2"
    assert json.loads((tmp_path / "results/r1/about.json").read_text())["settings"]["binarize"]["method"] == "otsu"
    with pytest.raises(RuntimeError, match="no samples match"):
        cli.evaluate(spark, str(tmp_path), settings, cli.RunFilter(sources=("nobody",)))
    with pytest.raises(RuntimeError, match="no ground truth"):
        cli.evaluate(spark, f"{tmp_path}/none", settings, cli.RunFilter())
    drawn = cli.draw_overlays(spark, str(tmp_path), settings, 1, 3, ("text",)).collect()
    assert [r.sample_id for r in drawn] == ["synth_1"]
    assert "| all | all | 1 | 13 | 100.0% |" in text and "| template | form | 1 | 13 |" in text and "| dpi | 100-149 |" in text


def test_legend_and_reasons():
    page = np.full((160, 200), 255, np.uint8)
    boxes = [(160, 20, 20, 20, "text"), (160, 60, 20, 20, "noise"), (160, 100, 10, 10, "noise")]
    out = O.legend(page, boxes, ("ms: 7",))
    panel = out[:120, :150]
    assert (panel == O.COLOURS["noise"]).all(axis=2).any() and (out[:, 150:] == 255).all()
    assert not (O.legend(page, boxes) == O.legend(page, boxes[:2])).all()  # counts differ
    marked = O.reasons(page, [(*boxes[0], "t1:frame")])
    assert (marked[10:20, 160:] == O.COLOURS["text"]).all(axis=2).any()
    assert O.letters("a", 3).shape == (15, 12) and O.letters("").shape[1] == 0
