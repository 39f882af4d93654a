"""Roll-ups: sums of counters and ratios of the sums, over five slice keys at once, and latency distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunFilter
from ..functions.geometry import dpi_bucket
from .matching import OUTCOMES, char_rates, word_rates
from .routing import KINDS
from .spatial import spread

CHAR_COUNTERS = ("n_gt", "n_surviving", *OUTCOMES, "junk", "junk_in_nontext", "small_gt", "small_retained")
WORD_COUNTERS = ("n_gt", "n_surviving", "hit", "crossing", "junk", "coverage_sum")
SLICES = ("capture", "source", "script", "dpi", "template")


def _and() -> Column:
    return F.coalesce(F.bool_and("gt_complete"), F.lit(False)).alias("gt_complete")


def aggregate_chars(facts: DataFrame, *by: str) -> DataFrame:
    """Sums of the counters; gt_complete holds if it does for every sample, and not for none."""
    return facts.groupBy(*by).agg(F.count("*").alias("samples"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CHAR_COUNTERS), _and())


def granularity() -> Column:
    found = F.collect_set(F.when(F.col("n_gt") > 0, F.col("granularity")))
    return F.when(F.size(found) == 0, "none").when(F.size(found) == 1, F.element_at(found, 1)).otherwise("mixed").alias("granularity")


def aggregate_words(facts: DataFrame, *by: str) -> DataFrame:
    return facts.groupBy(*by).agg(F.count("*").alias("samples"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in WORD_COUNTERS), granularity())


def with_slices(facts: DataFrame, samples: DataFrame) -> DataFrame:
    s = samples.select("sample_id", "capture", "source", "script", dpi_bucket(F.col("dpi")).alias("dpi"), F.when(F.coalesce("template", F.lit("")) == "", "-").otherwise(F.col("template")).alias("template"))
    return facts.join(s, "sample_id")


def sliced(facts: DataFrame, aggregates: list[Column]) -> DataFrame:
    """One pass over all five keys and the total: slice_key, slice and the aggregates."""
    sets = [[], *([k] for k in SLICES)]
    out = facts.groupingSets(sets, *SLICES).agg(*aggregates, F.grouping_id().alias("_gid"))
    bit = {k: 31 - (1 << (4 - i)) for i, k in enumerate(SLICES)}  # grouping_id is 0 in the bit of the key that is grouped by
    key = F.lit("all")
    value = F.lit("all")
    for k in SLICES:
        key = F.when(F.col("_gid") == bit[k], k).otherwise(key)
        value = F.when(F.col("_gid") == bit[k], F.col(k)).otherwise(value)
    return out.select(key.alias("slice_key"), value.alias("slice"), *[c for c in out.columns if c not in (*SLICES, "_gid")])


def char_slices(facts: DataFrame, samples: DataFrame) -> DataFrame:
    """Slices of samples that have characters; those without any are dropped."""
    rows = with_slices(facts.where("n_gt > 0"), samples)
    out = sliced(rows, [F.count("*").alias("samples"), *(F.sum(c).alias(c) for c in CHAR_COUNTERS), _and()]).where("n_gt > 0")
    return out.select("slice_key", "slice", "samples", "n_gt", *(F.round(c, 6).alias(n) for n, c in char_rates().items()))


def word_slices(facts: DataFrame, samples: DataFrame) -> DataFrame:
    rows = with_slices(facts, samples)
    out = sliced(rows, [F.count("*").alias("samples"), *(F.sum(c).alias(c) for c in WORD_COUNTERS), granularity()]).where("n_gt > 0")
    return out.select("slice_key", "slice", "samples", "granularity", "n_gt", *(F.round(c, 6).alias(n) for n, c in word_rates().items()))


def routing_by_capture(components: DataFrame, samples: DataFrame) -> DataFrame:
    joined = spread(components).join(samples.select("sample_id", "capture"), "sample_id")
    return joined.groupBy("capture").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))


def percentiles(values: DataFrame, column: str, *by: str) -> DataFrame:
    """Exact, linear: p50, p95, p99, mean, max, n; rounded to 3 decimals. Nothing for no rows."""
    p = lambda q: F.round(F.percentile(column, F.lit(q)), 3).alias(f"p{round(100 * q)}")
    # the mean by whole millionths: a sum of doubles would depend on the order of the rows
    mean = F.sum(F.bround(F.col(column) * 1e6).cast("long")) / F.count(column) / F.lit(1e6)
    return values.groupBy(*by).agg(p(0.5), p(0.95), p(0.99), F.round(mean, 3).alias("mean"), F.round(F.max(column), 3).alias("max"), F.count(column).alias("n")).where("n > 0")


def stage_medians(timings: DataFrame) -> DataFrame:
    """document, stage, ms: the median over a document's repeats; a stage that a repeat lacks counts as 0 there. Stage total is the median of the repeats' sums."""
    per = timings.groupBy("document", "repeat", "stage").agg(F.sum("ms").alias("ms"))
    repeats = per.select("document", "repeat").distinct()
    stages = per.select("document", "stage").distinct()
    dense = repeats.join(stages, "document").join(per, ["document", "repeat", "stage"], "left").withColumn("ms", F.coalesce("ms", F.lit(0.0)))
    total = per.groupBy("document", "repeat").agg(F.sum("ms").alias("ms")).withColumn("stage", F.lit("total"))
    return dense.unionByName(total.select(*dense.columns)).groupBy("document", "stage").agg(F.percentile("ms", F.lit(0.5)).alias("ms"))


def latency_summary(timings: DataFrame) -> DataFrame:
    """Percentiles over the documents that have the stage; total comes last in order."""
    return percentiles(stage_medians(timings), "ms", "stage").withColumn("last", (F.col("stage") == "total").cast("int"))


def stage_totals(timings: DataFrame) -> DataFrame:
    """A stage that is entered again adds up."""
    return timings.groupBy("document", "repeat", "stage").agg(F.sum("ms").alias("ms"))


def matching_samples(samples: DataFrame, f: RunFilter) -> DataFrame:
    for column, allowed in (("source", f.sources), ("capture", f.captures), ("script", f.scripts)):
        if allowed:
            samples = samples.where(F.col(column).isin(*allowed))
    return samples


def run_plan(samples: DataFrame, images: DataFrame, f: RunFilter) -> tuple[DataFrame, DataFrame]:
    """Samples to process and samples skipped for want of an image. The limit comes behind filter and image join."""
    chosen = matching_samples(samples, f)
    there = images.select("sample_id").distinct()
    present, skipped = chosen.join(there, "sample_id", "left_semi"), chosen.join(there, "sample_id", "left_anti")
    return (present.orderBy("sample_id").limit(f.limit) if f.limit else present), skipped


def pct(value: float | None) -> str:
    return "n/a" if value is None else f"{100 * value:.1f}%"


def markdown_table(headers: list[str], rows: list[list[object]]) -> str:
    lines = ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers)]
    return "\n".join([*lines, *("| " + " | ".join(str(v) for v in row) + " |" for row in rows)])


def percent(rate: Column) -> Column:
    """As pct, for columns: one decimal, rounded half to even."""
    return F.when(rate.isNull(), "n/a").otherwise(F.format_string("%.1f%%", F.bround(100 * rate, 1)))


def tallies(samples: DataFrame) -> DataFrame:
    """tally (all, template, capture or source), value, n, with_chars of samples (template, capture, source, has_chars) in one pass."""
    keys = ("template", "capture", "source")
    out = samples.groupingSets([[], *([k] for k in keys)], *keys).agg(F.count("*").alias("n"), F.count_if("has_chars").alias("with_chars"), *(F.grouping(k).alias(f"_{k}") for k in keys))
    name, value = F.lit("all"), F.lit("all")
    for k in keys:
        name, value = F.when(F.col(f"_{k}") == 0, k).otherwise(name), F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(value)
    return out.select(name.alias("tally"), value.alias("value"), "n", "with_chars")


def headline(chars: DataFrame, words: DataFrame, latency: DataFrame) -> list[tuple[str, str]]:
    """Label and text of the whole run's figures, from char_slices, word_slices and latency_summary."""
    c, w = chars.where("slice_key = 'all'").first(), words.where("slice_key = 'all'").first()
    t = latency.where("stage = 'total'").first()
    get = lambda row, name: None if row is None else row[name]
    labels = {"isolation_recall": "character isolation recall", "over_segmentation_rate": "over-segmentation rate", "merge_rate": "merge rate", "miss_rate": "miss rate", "junk_rate": "junk rate of survivors", "small_retention": "small-mark retention"}
    unit = get(w, "granularity") or "none"
    rows = [(label, pct(get(c, name))) for name, label in labels.items()]
    rows += [(f"region hit rate ({unit})", pct(get(w, "hit_rate"))), (f"region coverage ({unit})", pct(get(w, "mean_coverage")))]
    return [*rows, ("end to end P50 / P95 / P99 ms", " / ".join("n/a" if t is None else f"{t[p]:.1f}" for p in ("p50", "p95", "p99")))]


def latency_rows(latency: DataFrame) -> str:
    rows = latency.orderBy("last", "stage").collect()
    return markdown_table(["stage", "P50 ms", "P95 ms", "P99 ms", "max ms", "mean ms", "documents"], [[r.stage, r.p50, r.p95, r.p99, r.max, r["mean"], r.n] for r in rows])


def markdown_report(chars: DataFrame, words: DataFrame, latency: DataFrame, routing: DataFrame, by_capture: dict[str, DataFrame] | None = None, about: dict[str, object] | None = None) -> str:
    """The whole report; its inputs are small aggregates. by_capture: latency of each capture mode. about: facts of the run for its head."""
    parts = ["# Benchmark report"]
    if about:
        parts.append("\n".join(f"- {k}: {v}" for k, v in about.items()))
    parts += ["## Headline", markdown_table(["metric", "value"], [list(r) for r in headline(chars, words, latency)])]
    names = list(char_rates())
    rows = chars.orderBy("slice_key", "slice").collect()
    parts += ["## Characters", markdown_table(["key", "slice", "samples", "GT chars", *names], [[r.slice_key, r.slice, r.samples, r.n_gt, *(pct(r[n]) for n in names)] for r in rows])]
    names = list(word_rates())
    rows = words.orderBy("slice_key", "slice").collect()
    parts += ["## Regions", markdown_table(["key", "slice", "samples", "unit", "GT regions", *names], [[r.slice_key, r.slice, r.samples, r.granularity, r.n_gt, *(pct(r[n]) for n in names)] for r in rows])]
    parts += ["## Latency by stage", latency_rows(latency)]
    for name, d in sorted((by_capture or {}).items()):
        parts += [f"### Latency: {name}", latency_rows(d)]
    parts += ["## Component routing", markdown_table(["capture", *KINDS], [[r.capture, *(r[k] for k in KINDS)] for r in routing.orderBy("capture").collect()])]
    return "\n\n".join(parts) + "\n"
