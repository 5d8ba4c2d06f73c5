"""Mixing sources to target weights along a low-discrepancy schedule.

The mix is a sequence of slots of about BLOCK words each. Slot i belongs to the source under the point
frac((i + 1/2) * golden ratio) of the cumulative weights, so every stretch of the mix has nearly the
target shares. The slots of a source share its target evenly, to the word: the k-th takes the k-th block of that source's
words, in an order shuffled by hash, and the words begin again after the last one. A source that no point meets (its
target is below two slots then) has one slot at the end. All ranks and offsets are two-level prefix sums:
by chunks first, then within a chunk, so that a source with a third of all rows is no single task. A source of n documents
has the square root of n chunks, so neither level meets more than that many rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import join_lookup, materialise, n_words_expr, unique_column

GOLDEN = 0.6180339887498949
#: Words in a slot, about, and the least number of slots; small corpora get smaller slots.
BLOCK, LEAST_SLOTS = 1024, 1 << 14
#: Weights by rank of the source.
WEIGHTS = (3, 1, 2)
FACTOR, MOST = 1.5, 2.0
#: Slots in a chunk of the schedule.
CHUNK_SLOTS = 1 << 16


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, factor: float = FACTOR, most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source.

    Sources in code point order, null last, weigh weights[0], weights[1], ... in turn, and share factor times all
    words. A source stops at `most` times its size; the excess goes to the others by weight until none is above.
    """
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = factor * sum(size.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * size[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def schedule(spark, cumulative: list[float], n_slots: int) -> DataFrame:
    """(slot, source_no, rank): the source of each slot and its rank among that source's slots."""
    bounds = F.array(*[F.lit(float(x)) for x in cumulative[:-1]]) if len(cumulative) > 1 else None
    point = (F.col("slot") + 0.5) * GOLDEN
    point = point - F.floor(point)
    number = F.size(F.filter(bounds, lambda b: b <= point)) if bounds is not None else F.lit(0)
    slots = (
        spark.range(n_slots).withColumnRenamed("id", "slot")
        .withColumn("source_no", number.cast("int")).withColumn("part", F.floor(F.col("slot") / CHUNK_SLOTS))
    )
    counts = slots.groupBy("source_no", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_no", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source_no", "part").orderBy("slot")
    ranked = slots.withColumn("in_part", F.row_number().over(inner) - 1).join(before, ["source_no", "part"])
    return ranked.select("slot", "source_no", (F.col("before") + F.col("in_part")).alias("rank"))


def taken(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document.

    docs: doc_id, text, source, any other columns. Returns doc_id, size, source_size, target, taken.
    A null text has no words and counts as size 0, nothing is taken of it; null is a source of its own;
    repeated rows are mixed as rows of their own; an empty table gives an empty result. Other columns are not read.
    The same rows give the same result at any partitioning.
    """
    return _taken(docs).drop("source", "tie")


def _taken(docs: DataFrame) -> DataFrame:
    """taken, with each row's source and the hash of its text."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", "source", n_words_expr(F.col("text")).alias("size"),
        F.xxhash64(F.col("doc_id"), F.lit(17)).alias("h"), F.xxhash64("text").alias("tie"),
    )
    rows = materialise(rows, "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).collect()
    plan = targets([(r.source, r.source_size) for r in by_source])
    want = sum(plan.values())
    names = sorted((s for s in plan if s is not None)) + [None] * (None in plan)
    block = max(1, min(BLOCK, int(want // LEAST_SLOTS)))
    n_slots = max(1, round(want / block))
    acc, cumulative = 0.0, []
    for s in names:
        acc += plan[s] / want if want else 0
        cumulative.append(acc)
    known = {r.source: r for r in by_source}
    slots = materialise(schedule(spark, cumulative, n_slots if want else 0), "slots")
    met = {r.source_no: r.n for r in slots.groupBy("source_no").agg(F.count("*").alias("n")).collect()}
    goals = [round(plan[s]) for s in names]
    missed = [(n_slots + k, i, 0) for k, i in enumerate(i for i, g in enumerate(goals) if g and i not in met)]
    if missed:
        slots = slots.unionByName(spark.createDataFrame(missed, "slot long, source_no int, rank long"))
    lookup = spark.createDataFrame(
        [
            (i, s, s is None, int(known[s].source_size), float(plan[s]), max(1, math.isqrt(known[s].n_docs)), goals[i], *divmod(goals[i], met.get(i, 1)))
            for i, s in enumerate(names)
        ],
        "source_no int, name string, is_null boolean, source_size long, target double, n_chunks int, goal long, block long, longer long",
    )
    keyed = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("is_null", F.col("source").isNull())
    lookup = lookup.withColumn("name", F.coalesce("name", F.lit("")))
    keyed = join_lookup(keyed, lookup, ["name", "is_null"], "inner").withColumn("chunk", F.pmod(F.shiftright(F.col("h"), 20), F.col("n_chunks")).cast("int"))

    chunk_sizes = keyed.groupBy("source_no", "chunk").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunk_sizes.select("source_no", "chunk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("chunk_start"))
    inner = Window.partitionBy("source_no", "chunk").orderBy("h", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(inner)).join(starts, ["source_no", "chunk"])
    placed = placed.withColumn("start", F.col("chunk_start") + F.col("upto") - F.col("size"))

    # the source's words, again and again up to its goal, cut into its slots: the first `longer` have block + 1 words, the others block
    long_words = F.col("longer") * (F.col("block") + 1)
    slot_of = lambda x: F.when(x < long_words, F.call_function("div", x, F.col("block") + 1)).otherwise(F.col("longer") + F.call_function("div", x - long_words, F.greatest("block", F.lit(1))))
    begin = F.col("rank") * F.col("block") + F.least("rank", "longer")
    end = begin + F.col("block") + (F.col("rank") < F.col("longer")).cast("long")
    row = ["source_no", "source", "doc_id", "h", "tie", "start", "size", "source_size", "target"]
    rounds = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.greatest(F.col("goal") - 1, F.lit(0)), F.greatest("source_size", F.lit(1))))
    reached = (F.col("size") > 0) & (F.col("start") < F.col("goal"))
    passes = placed.filter(reached).withColumn("round", F.explode(rounds)).withColumn("low", F.col("round") * F.col("source_size") + F.col("start"))
    passes = passes.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("goal"))).filter("low < high")
    pieces = passes.select(
        *row, "low", "high", "block", "longer",
        F.explode(F.sequence(slot_of(F.col("low")), slot_of(F.col("high") - 1))).alias("rank"),
    )
    inside = F.least(F.col("high"), end) - F.greatest(F.col("low"), begin)
    got = pieces.join(slots.select("source_no", "rank"), ["source_no", "rank"]).groupBy(*row).agg(F.sum(inside).alias("taken"))
    none = placed.filter(~reached)
    shape = lambda df, t: df.select("doc_id", "source", "tie", "size", F.col("source_size").cast("long").alias("source_size"), "target", t.cast("long").alias("taken"))
    return shape(got, F.col("taken")).unionByName(shape(none, F.lit(0)))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each as often as the mix takes it, in whole copies.

    A document of which the schedule takes at least half of its words once more is given once more. Documents
    that aren't taken, and those without words, go. Rows are told apart by doc_id, text and source, a null of either like any
    value; rows that repeat all three are mixed each, and given as often as the one that is taken most. Other columns are kept.
    """
    copies, copy, tie = unique_column(docs, "copies"), unique_column(docs, "copy"), unique_column(docs, "tie")
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    share = _taken(docs).groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("tie").alias("_tie")).agg(F.max(n).alias(copies)).filter(F.col(copies) > 0)
    marked = docs.withColumn(tie, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(share["_doc"]) & marked["source"].eqNullSafe(share["_source"]) & (marked[tie] == share["_tie"])
    return marked.join(share, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
