"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Documents to a shuffle bucket, steps of virtual time, and rows of a step that is settled row by row: bounds on what one window partition holds.
PER_BUCKET, STEPS, EDGE = 2000, 1 << 12, 10_000


def source_targets(sizes: DataFrame, weights: DataFrame | None = None, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for sizes(source, size).

    The budget (a share of all sizes) is split by weight; no target exceeds
    ``most`` times its source's size, and the excess is split again by weight
    among the others until none is above: the water level at which the
    targets, each min(cap, level * weight), sum to the budget. Works on one row
    per source. ``weights`` has source and weight; sources it lacks weigh 0.
    Without it, sources by code point, null last, weigh 3, 1, 2, repeating.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        per = per.withColumn("weight", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), ((rank - 1) % 3 + 1).cast("int")))
    else:
        w = weights.select(F.col("source").alias("wsource"), F.col("weight").cast("double").alias("weight"))
        per = per.join(w, F.col("source").eqNullSafe(F.col("wsource")), "left").drop("wsource").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    ordered = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    before, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    live = F.when(F.col("ratio").isNotNull(), F.col("weight")).otherwise(0.0)
    per = per.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_from", F.sum(live).over(whole) - F.coalesce(F.sum(live).over(before), F.lit(0.0)))
    total = F.sum("source_size").over(whole) * F.lit(budget)
    # the level if this source and all after it stay below their caps
    per = per.withColumn("level", F.when(F.col("ratio").isNotNull(), (total - F.col("cap_before")) / F.col("weight_from")))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"]
    target = F.when(F.col("ratio").isNull(), F.lit(0.0)).when(level.isNull() | (F.col("ratio") < level), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _cut(copies: DataFrame, spend: float) -> tuple[float, str]:
    """The last (f, shuffled) that the budget pays for, of copies(size, shuffled, f); infinite if it pays for all.

    Virtual time is mapped to 0..1 and dealt to STEPS steps; the one in which the
    budget ends is dealt to STEPS finer ones, and so on until it holds few rows.
    """
    low, scale, before = 0.0, float(STEPS), 0.0
    while True:
        step = F.floor((F.col("f") / (F.col("f") + 1) - F.lit(low)) * F.lit(scale))
        steps = copies.groupBy(step.alias("step")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))  # at most STEPS rows but for rounding
        through = steps.withColumn("upto", F.sum("s").over(Window.orderBy("step")) + F.lit(before))
        cut = through.where(F.col("upto") > F.lit(spend)).agg(F.min(F.struct("step", (F.col("upto") - F.col("s")).alias("before"), "n")).alias("c")).first()["c"]  # one row
        if cut is None:
            return float("inf"), ""
        copies, before = copies.where(step == cut["step"]), cut["before"]
        if cut["n"] <= EDGE or scale >= 2.0**48:  # finer than doubles
            break
        low, scale = low + cut["step"] / scale, scale * STEPS
    last = copies.groupBy("f", "shuffled").agg(F.sum("size").alias("size"))
    edge = last.withColumn("upto", F.sum("size").over(Window.orderBy("f", "shuffled"))).agg(F.max(F.when(F.col("upto") <= F.lit(spend - before), F.struct("f", "shuffled"))).alias("m"), F.min("f").alias("first")).first()
    return (edge["m"]["f"], edge["m"]["shuffled"]) if edge["m"] else (edge["first"], "")


def mix(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, key, source, size, source_size, target, copies, taken, finish.

    Each source's documents come in a fixed shuffled order (md5 of seed, id and
    text), round after round up to ``most`` rounds. A document's virtual finish
    time is the source's words up to and including it divided by the source's
    target. The mix takes documents by finish time until the total budget (the
    sum of the targets) is used up: a document is taken as often as its rounds'
    finish times come before the cut. ``finish`` is that of the first round.

    Running sums are made in two levels, so a source with a third of all rows is
    spread over many tasks: sums of shuffle buckets of about PER_BUCKET documents,
    then inside each bucket. The cut works the same way: see ``_cut``.

    Edge cases: very long texts count whole; null texts have size 0 and, like empty ones, are taken with the
    words before them; a null source is a source of its own, last in order; ties
    (repeated rows) share a shuffle key and are taken together, which may pass
    the budget by their size; an empty table gives an empty result; further
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(text)
    base = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            key.alias("key"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        ).withColumn("shuffled", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "key"))),
        "mix-sizes",
    )
    bits = min(32, (base.count() // PER_BUCKET).bit_length())  # of the shuffle key: buckets are ranges of it
    base = base.withColumn("bucket", F.shiftright(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long"), 32 - bits))
    targets = source_targets(base, weights, budget, float(most))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    starts = sums.select(F.col("source").alias("bsource"), F.col("bucket").alias("bbucket"), F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    inside = Window.partitionBy("source", "bucket").orderBy("shuffled")  # ties together: the range frame
    timed = (
        base.withColumn("s1", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("bsource")) & (F.col("bucket") == F.col("bbucket")))
        .drop("bsource", "bbucket")
        .join(targets.withColumnRenamed("source", "tsource"), F.col("source").eqNullSafe(F.col("tsource")))
        .withColumn("upto", F.col("s0") + F.col("s1"))
    )
    finish = lambda k: F.when(F.col("target") > 0, (F.col("upto") + F.col("source_size") * F.lit(k)) / F.col("target"))
    timed = materialize(timed.select("doc_id", "key", "source", "size", "source_size", "target", "shuffled", F.array(*[finish(k) for k in range(most)]).alias("finishes")), "mix-times")

    spend = targets.agg(F.sum("target").alias("spend")).first()["spend"] or 0.0
    limit_f, limit_k = _cut(timed.select("size", "shuffled", F.explode("finishes").alias("f")).where("f IS NOT NULL AND size > 0"), float(spend))
    taken = F.size(F.filter("finishes", lambda f: f.isNotNull() & ((f < F.lit(limit_f)) | ((f == F.lit(limit_f)) & (F.col("shuffled") <= F.lit(limit_k))))))
    return timed.withColumn("copies", taken.cast("long")).select("doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.col("finishes")[0].alias("finish"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: every document as often as its copies say, globally range-sorted by virtual finish time; docs' columns.

    Edge cases are those of ``mix``; of rows that share id, source and text each comes
    as often as the mix takes them; columns of docs may have any name but those that
    begin with __lw_.
    """
    plan = mix(docs, **options)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    src = options.get("source_col", "source")
    once = plan.groupBy("doc_id", "key", "source").agg(F.max("copies").alias("__lw_copies"), F.max("finish").alias("__lw_finish")).select(F.col("doc_id").alias("__lw_id"), F.col("key").alias("__lw_key"), F.col("source").alias("__lw_source"), "__lw_copies", "__lw_finish").where("__lw_copies > 0")
    key = F.md5(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.join(once, docs[id_col].eqNullSafe(once["__lw_id"]) & docs[src].cast("string").eqNullSafe(once["__lw_source"]) & (key == once["__lw_key"]))
    rows = rows.withColumn("__lw_round", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__lw_copies"))))
    return rows.repartitionByRange("__lw_finish", "__lw_round", "__lw_key").sortWithinPartitions("__lw_finish", "__lw_round").select(*[docs[c] for c in docs.columns])
