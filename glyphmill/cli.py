"""Command line: python -m glyphmill.cli {run,report,overlays,synth,manifest,plan} ...

run evaluates a store, keeps the results under <root>/results/<run id> and prints the report; report prints a kept one again.
"""

from __future__ import annotations

import argparse
import json
import platform
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunFilter, Settings
from .operators import matching, overlays, raster, reports, synth
from .operators.annotations import truth_tables
from .sources.store import Store, encoded, images


def evaluate(spark: SparkSession, root: str, settings: Settings, f: RunFilter, repeats: int = 3, warmup: int = 1, run_id: str | None = None) -> str:
    """Run the samples of a store that match and have an image, keep the results if there is a run_id, and give the report.

    Each image goes through the kernels once for its components, and warmup + repeats times for its timings. No samples, or none that match: an error.
    """
    store = Store(spark, root)
    everything = store.read()
    if everything.isEmpty():
        raise RuntimeError(f"no ground truth under {root}/gt")
    chosen, skipped = reports.run_plan(everything, store.images(), f)
    if chosen.isEmpty():
        raise RuntimeError("no samples match the filters")
    pictures = images(spark, f"{root}/images").join(chosen.select("sample_id"), "sample_id", "left_semi")
    found = raster.run_pages(pictures, settings).persist()
    timings = raster.run_timed(pictures, settings, repeats, warmup).persist()  # a second pass would measure other times
    truth = truth_tables(chosen)
    samples = chosen.withColumn("template", F.col("meta")["template"]).withColumn("gt_complete", F.coalesce(F.col("meta")["gt_complete"].cast("boolean"), F.col("source") == "synth"))
    facts = {
        "chars": matching.char_metrics(found, truth["chars"], truth["regions_nontext"], samples),
        "words": matching.word_metrics(found, truth["words"], truth["lines"], samples),
        "kinds": found.groupBy("sample_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in reports.KINDS)),
        "timings": reports.stage_medians(timings).withColumnRenamed("document", "sample_id"),
        "skipped": skipped.select("sample_id"),
    }
    about = {
        "run": run_id, "platform": platform.platform(), "python": platform.python_version(), "repeats": f"{repeats} (+{warmup} warm-up), percentiles over documents",
        "samples": samples.count(), "skipped for want of an image": facts["skipped"].count(), "filter": asdict(f), "settings": asdict(settings),
    }
    shown = {k: v for k, v in about.items() if k not in ("filter", "settings") and v is not None}
    captures = [r.capture for r in samples.select("capture").distinct().orderBy("capture").collect()]
    by_capture = {c: reports.latency_summary(timings.join(samples.where(F.col("capture") == c).select(F.col("sample_id").alias("document")), "document", "left_semi")) for c in captures}
    text = reports.markdown_report(reports.char_slices(facts["chars"], samples), reports.word_slices(facts["words"], samples), reports.latency_summary(timings), reports.routing_by_capture(found, samples), by_capture, shown)
    if run_id:
        store.save_run(run_id, facts, about, text)
    for d in (found, timings):
        d.unpersist()
    return text


def kept_report(spark: SparkSession, root: str, run_id: str) -> str:
    return "\n".join(r.value for r in spark.read.text(f"{root.rstrip('/')}/results/{run_id}/summary.md").collect())


def draw_overlays(spark: SparkSession, root: str, settings: Settings, limit: int | None, seed: int, kinds: tuple[str, ...]) -> DataFrame:
    """sample_id, png: routed components on a spread of the store's images, with legend and reasons."""
    store = Store(spark, root)
    ids = store.images().select("sample_id").join(store.sample_ids(), "sample_id", "left_semi")
    ids = overlays.sampled(ids, limit, seed) if limit else ids
    pictures = images(spark, f"{root}/images").join(ids, "sample_id", "left_semi")
    return overlays.overlays(pictures, raster.run_pages(pictures, settings), kinds, with_legend=True, with_reasons=True)


def generate(spark: SparkSession, root: str, count: int, seed: int) -> list[tuple]:
    """Generate count samples into a store, and say how many there are of each template, capture and source."""
    made = synth.generate(synth.plan(spark, count, seed)).persist()
    store, samples = Store(spark, root), synth.as_samples(made)
    store.write(samples)
    store.put_images(encoded(made))
    told = samples.select(F.col("meta")["template"].alias("template"), "capture", "source", (F.size("chars") > 0).alias("has_chars"))
    out = [tuple(r) for r in reports.tallies(told).orderBy("tally", "value").collect()]
    made.unpersist()
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    commands = {name: sub.add_parser(name) for name in ("run", "report", "overlays", "synth", "manifest", "plan")}
    for name in ("run", "report", "overlays", "synth", "manifest"):
        commands[name].add_argument("root")
    for name in ("run", "overlays"):
        commands[name].add_argument("--config")
        commands[name].add_argument("--limit", type=int)
    for name in ("plan", "synth", "overlays"):
        commands[name].add_argument("--seed", type=int, default=7)
    commands["plan"].add_argument("count", type=int)
    commands["synth"].add_argument("--count", type=int, default=150)
    commands["report"].add_argument("run_id")
    commands["overlays"].add_argument("--kinds", nargs="*", default=list(reports.KINDS))
    for key in ("source", "capture", "script"):
        commands["run"].add_argument(f"--{key}", nargs="*", default=[])
    commands["run"].add_argument("--repeats", type=int, default=3)
    commands["run"].add_argument("--warmup", type=int, default=1)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    settings = Settings.from_dict(json.load(open(a.config)) if getattr(a, "config", None) else None)
    if a.command == "plan":
        synth.plan(spark, a.count, a.seed).orderBy("i").show(a.count, truncate=False)
    elif a.command == "manifest":
        Store(spark, a.root).write_manifest()
    elif a.command == "synth":
        for row in generate(spark, a.root, a.count, a.seed):
            print(*row)
    elif a.command == "overlays":
        Store(spark, a.root).put_images(draw_overlays(spark, a.root, settings, a.limit, a.seed, tuple(a.kinds)), "overlays")
    elif a.command == "report":
        print(kept_report(spark, a.root, a.run_id))
    else:
        run_id = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
        f = RunFilter(tuple(a.source), tuple(a.capture), tuple(a.script), a.limit)
        print(evaluate(spark, a.root, settings, f, a.repeats, a.warmup, run_id))


if __name__ == "__main__":
    main()
