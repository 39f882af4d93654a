"""Mixing sources to target weights by Pareto order sampling.

A document is expected to be taken r = min(MOST, c * w) times. w is its weight by length (LENGTH_ODDS: shorter documents weigh more, so a
source's words hang less on a few long ones), and c of a source is such that the expected words come to its target. Each document gets floor(r)
certain copies. What is left of the target is filled by Pareto order sampling: with inclusion probability p = r - floor(r), which differs
among the documents of a source, and a uniform draw u a document ranks by (u / (1 - u)) / (p / (1 - p)), and the lowest ranks are taken while their words fit.

No source is gathered in one task: the rank is mapped to (0, 1), so words are summed by (source, bin of
rank), a window over the bins of a source finds the bin in which the remainder runs out, and only the
documents of that one bin are ordered. What is still open is a rounding step of at most FILL_ROUNDS documents a source: the next in order of rank
that fits, and in the last round the one whose size comes nearest, above or below. Only that last document is chosen by size and not by rank.

Edge cases. Null text: size 0. Null source: a source of its own, last. Documents of size 0 are taken 0 times.
Draws come from id and text, so documents that share an id differ; ties of rank: by id, then by row (rows that share id and text are alike,
and it doesn't matter which of them is taken). Null ids: take part. Empty table: empty result. Sources that are all empty: target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3.0
BINS = 4096
#: Weights of documents by length: up to so many words, and any number.
LENGTH_ODDS = ((250, 3), (2500, 2), (None, 1))
FILL_ROUNDS = 3


def uniform(id_col: F.Column, text_col: F.Column) -> F.Column:
    """A uniform draw in (0, 1) that depends on id and text alone: 52 bits of an md5."""
    own = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text_col.cast("string"), F.lit("")).cast("binary")))
    n = F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("double")
    return (n + 0.5) / F.lit(float(1 << 52))


def weight_of(size: F.Column) -> F.Column:
    out = F.lit(LENGTH_ODDS[-1][1])
    for most, w in LENGTH_ODDS[-2::-1]:
        out = F.when(size <= most, w).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, target. sizes: source, size.

    Water filling in closed form. A source is full at most * size; by ascending fullness level
    most * size / weight the first k sources are full, and the others share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    n = len(weights)
    by_name = W.orderBy(F.col("source").isNull().cast("int"), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("w")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull().cast("int"), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = (
        per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open_w"))
    )
    per = per.withColumn("k", F.row_number().over(order))
    stops = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("k", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(stops * F.col("w"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def expected(targets: DataFrame, words: DataFrame, most: float) -> DataFrame:
    """targets with c, and rest: what certain copies leave of the target. words: source and the words n0, n1, .. of each weight.

    The weights with the most copies stop at most first, so c is the first of a few quotients that no open weight exceeds.
    """
    weights = [w for _, w in LENGTH_ODDS]
    t = targets.join(words.withColumnRenamed("source", "w_source"), F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    c = F.lit(float(most))
    for k in reversed(range(len(weights))):
        full = sum((F.col(f"n{i}") for i in range(k)), F.lit(0)) * F.lit(float(most))
        open_words = sum((F.col(f"n{i}") * weights[i] for i in range(k, len(weights))), F.lit(0))
        share = F.try_divide(F.col("target") - full, open_words.cast("double"))
        c = F.when(share * float(weights[k]) <= float(most), share).otherwise(c)
    t = t.withColumn("c", c)
    certain = sum((F.floor(F.least(F.lit(float(most)), F.col("c") * float(w))) * F.col(f"n{i}") for i, w in enumerate(weights)), F.lit(0))
    return t.withColumn("rest", F.col("target") - certain).drop(*(f"n{i}" for i in range(len(weights))))


def copies_of(size: F.Column, c: F.Column, most: float) -> F.Column:
    """Expected copies of a document."""
    return F.least(F.lit(float(most)), c * weight_of(size).cast("double"))


def rank_of(size: F.Column, r: F.Column, u: F.Column) -> F.Column:
    """Rank in (0, 1) by random odds over inclusion odds; null for what takes no part."""
    p = r - F.floor(r)
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when((size > 0) & (p > 0), odds / (1 + odds))


def size_of(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, one row per row of docs."""
    d, extra = _decided(docs, id_col, text_col, source_col, weights, most)
    d = d.join(extra.select(F.col("row").alias("x_row"), F.lit(1).alias("more")), F.col("row") == F.col("x_row"), "left")
    copies = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + F.col("hit") + F.coalesce("more", F.lit(0))).otherwise(0).cast("long")
    return d.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """docs with each row as often as mix takes it; all columns as they are, and no column name is reserved.

    The decisions are a row a source: c, the last rank that is taken, and the few documents that are decided one by one (those that fill up, and rows
    alike of which some are taken). So no text is shuffled. Of rows that share id and text, one stands for the extra copies.
    """
    d, extra = _decided(docs, id_col, text_col, source_col, weights, most)
    d = d.join(extra.select(F.col("row").alias("x_row"), F.lit(1).alias("more")), F.col("row") == F.col("x_row"), "left")
    last = d.where("hit = 1").groupBy("source").agg(F.max(F.struct("rank", "doc_id", "ta", "tb")).alias("last")).select(F.col("source").alias("l_source"), "last")
    # classes of rows alike that are not wholly on one side of the last rank: those of it, and those that fill up
    own = ["source", "doc_id", "ta", "tb"]
    picked = d.where("more = 1").select(*own).unionByName(last.select(F.col("l_source").alias("source"), "last.doc_id", "last.ta", "last.tb")).distinct()
    same = F.lit(True)
    for c in own:
        same &= F.col(c).eqNullSafe(F.col(f"p_{c}"))
    classes = d.join(picked.toDF(*(f"p_{c}" for c in own)), same, "left_semi").groupBy(*own).agg(F.sum(F.col("hit") + F.coalesce("more", F.lit(0))).cast("long").alias("extra"))
    special = classes.groupBy("source").agg(F.collect_list(F.struct("doc_id", "ta", "tb", "extra")).alias("special")).select(F.col("source").alias("s_source"), "special")
    per = d.groupBy("source").agg(F.first("c").alias("c")).withColumnRenamed("source", "of")
    per = per.join(last, F.col("of").eqNullSafe(F.col("l_source")), "left").join(special, F.col("of").eqNullSafe(F.col("s_source")), "left")
    plan = common.written(per.select("of", F.struct("c", "last", "special").alias("plan")), "mix-plan")

    at = lambda c: docs[common.quoted(c)]
    packed = docs.select(
        F.struct(*(at(c) for c in docs.columns)).alias("row"), at(source_col).cast("string").alias("source"), at(id_col).cast("long").alias("doc_id"), size_of(at(text_col)).alias("size"),
        uniform(at(id_col), at(text_col)).alias("u"), *(k.alias(n) for k, n in zip(common.text_key(at(text_col)), ("ta", "tb"), strict=True)),
    ).where("size > 0")
    joined = packed.join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
    r = copies_of(F.col("size"), F.col("plan.c"), most)
    joined = joined.withColumn("whole", F.coalesce(F.floor(r), F.lit(0)).cast("long")).withColumn("rank", rank_of(F.col("size"), r, F.col("u")))
    alike = lambda x: x["doc_id"].eqNullSafe(F.col("doc_id")) & (x["ta"] == F.col("ta")) & (x["tb"] == F.col("tb"))
    joined = joined.withColumn("one", F.element_at(F.concat(F.filter(F.coalesce("plan.special", F.array().cast("array<struct<doc_id:bigint,ta:bigint,tb:bigint,extra:bigint>>")), alike), F.array(F.lit(None))), 1)["extra"])
    hit = F.coalesce(F.struct("rank", "doc_id", "ta", "tb") <= F.col("plan.last"), F.lit(False)) & F.col("rank").isNotNull()
    n = F.col("whole") + F.when(F.col("one").isNull() & hit, 1).otherwise(0)
    plain = joined.select("row", n.cast("long").alias("n"))
    once = joined.where("one > 0").groupBy("source", "doc_id", "ta", "tb").agg(F.min_by("row", F.to_json("row")).alias("row"), F.max("one").alias("n")).select("row", "n")
    out = plain.unionByName(once).where("n > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], most: float) -> tuple[DataFrame, DataFrame]:
    """Each row with its whole copies, rank and hit; and the rows (source, size, row) that fill up."""
    at = lambda c: docs[common.quoted(c)]
    keys = [k.alias(n) for k, n in zip(common.text_key(at(text_col)), ("ta", "tb"), strict=True)]
    narrow = docs.select(at(id_col).cast("long").alias("doc_id"), at(source_col).cast("string").alias("source"), size_of(at(text_col)).alias("size"), uniform(at(id_col), at(text_col)).alias("u"), *keys, F.monotonically_increasing_id().alias("row"))
    narrow = common.written(narrow, "mix")
    w = weight_of(F.col("size"))
    words = narrow.groupBy("source").agg(*(F.coalesce(F.sum(F.when(w == x, F.col("size"))), F.lit(0)).cast("long").alias(f"n{i}") for i, (_, x) in enumerate(LENGTH_ODDS)))
    targets = common.written(expected(source_targets(narrow, weights, most), words, most), "mix-targets")
    t = targets.withColumnRenamed("source", "t_source")
    d = narrow.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    r = copies_of(F.col("size"), F.col("c"), most)
    d = d.withColumn("whole", F.coalesce(F.floor(r), F.lit(0)).cast("long")).withColumn("rank", rank_of(F.col("size"), r, F.col("u"))).drop("u")
    d = common.written(d.withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int")), "mix-ranked")

    key = [F.col("source")]
    bins = d.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(W.partitionBy(*key).orderBy("bin"))
    bins = bins.withColumn("upto", upto)
    edge = bins.where("upto > rest").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("base"))).alias("e"))
    edge = edge.select(F.col("source").alias("e_source"), F.col("e.bin").alias("edge"), F.col("e.base").alias("base"))
    d = d.join(common.written(edge, "mix-edge"), F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    inside = d.where("bin = edge")
    run = F.sum("size").over(W.partitionBy(*key).orderBy("rank", "doc_id", "ta", "tb", "row"))
    inside = inside.withColumn("hit", (F.col("base") + run <= F.col("rest")).cast("int"))
    outside = d.where("rank is null or edge is null or bin <> edge").withColumn("hit", F.when(F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))), 1).otherwise(0))
    d = outside.unionByName(inside)
    return _filled(d)


def _filled(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill what is open in each source, a document a round."""
    d = common.written(d.select("doc_id", "source", "size", "ta", "tb", "row", "source_size", "target", "c", "whole", "rest", "rank", "hit"), "mix-hit")
    extra = d.select("source", "size", "row").limit(0)
    state = d.where("rest > 0").groupBy("source").agg(F.first("rest").alias("rest"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("size"))), F.lit(0)).alias("have"))
    state = common.written(state.select(F.col("source").alias("s_source"), (F.col("rest") - F.col("have")).alias("open")), "mix-open")
    for turn in range(FILL_ROUNDS):
        free = d.where("hit = 0 and rank is not null").select("source", "size", "rank", "doc_id", "ta", "tb", "row")
        free = free.join(extra.select(F.col("row").alias("x_row")), F.col("row") == F.col("x_row"), "left_anti")
        off = F.abs(F.col("size") - F.col("open"))
        fits = free.join(state, F.col("source").eqNullSafe(F.col("s_source")))
        nearest = turn == FILL_ROUNDS - 1
        fits = fits.where(off < F.col("open") if nearest else F.col("size") <= F.col("open"))
        order = [off.alias("off"), (-F.col("size")).alias("m")] if nearest else []
        best = fits.groupBy("source").agg(F.min(F.struct(*order, "rank", "doc_id", "ta", "tb", "row", "size")).alias("b"))
        pick = best.select("source", "b.size", "b.row")
        extra = common.written(extra.unionByName(pick), "mix-fill")
        got = extra.groupBy("source").agg(F.sum("size").alias("got")).withColumnRenamed("source", "g_source")
        opened = state if turn == 0 else opened
        state = opened.join(got, F.col("s_source").eqNullSafe(F.col("g_source")), "left").select("s_source", (F.col("open") - F.coalesce("got", F.lit(0))).alias("open"))
    return d, extra


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
