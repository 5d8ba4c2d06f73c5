"""Removal of repeated runs of lines, by a suffix array over line numbers.

The corpus is one sequence of lines in the order of (doc_id, line); no run crosses a document's end. Prefix doubling ranks
the runs that start at each place: first single lines, then runs of 2, 4, 8, ... by the ranks of their halves. Ranks go to
the different runs that are met twice, in their sorted order, so the places of one rank are an interval of the suffix array
with a common prefix of that length. A place whose run is met once leaves the race, so later rounds hold what repeats
alone. In each interval of MIN_LINES lines or more the first place in the corpus stays; what it has in common with the
later ones is deleted there. The intervals' union is the maximal repeated runs.
With MIN_LINES of one the first round's places cover those of all later rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import in_arrow, join_hot, materialise

#: Lines that a repeated run has at least: a power of two. 1: a line on its own counts too, whatever its length.
MIN_LINES = 1
#: Null ids come after all others.
LAST = np.iinfo(np.int64).max


def _ranked(places: DataFrame, total: int) -> DataFrame:
    """(doc, h, line, rank, first) of the places whose key is met twice; first: the first place with that key, in corpus order.

    Keys are counted by a grouped aggregation, and only keys are sorted, so a key with a third of all places is one row here.
    """
    place = F.struct("doc", "h", "line")
    keys = places.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    # after a range partitioning and a sort, the row number that Spark makes up ascends with the key
    ranked = materialise(keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("rank", F.monotonically_increasing_id()), "line-ranks")
    return materialise(join_hot(places, ranked, "key", "n", total).select("doc", "h", "line", "rank", "first"), "line-places")


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc, h, line, size): runs of `size` lines that an earlier place of the corpus has too."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    body = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line", "body")
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"), F.xxhash64("text").alias("h"), body)
    lines = lines.select("doc", "h", "line", F.struct(F.xxhash64("body").alias("x"), F.xxhash64(F.lit("line"), F.col("body")).alias("y")).alias("key"))
    lines = materialise(lines.dropDuplicates(["doc", "h", "line"]), "lines")  # rows that repeat id and text are one place
    total = lines.count()  # no later table of places has more rows
    size, active, found = 1, _ranked(lines, total), []
    while True:
        here = F.struct("doc", "h", "line")
        if size >= min_lines:
            found.append(active.filter(here > F.col("first")).select("doc", "h", "line", F.lit(size).alias("size")))
        if found and not active.limit(1).count():
            break
        right = active.select("doc", "h", (F.col("line") - size).alias("line"), F.col("rank").alias("right"))
        halves = active.join(right, ["doc", "h", "line"]).select("doc", "h", "line", F.struct(F.col("rank").alias("x"), F.col("right").alias("y")).alias("key"))
        active, size = _ranked(halves, total), 2 * size
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _kept(batches):
    for batch in batches:
        n, gone, texts = [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or "").split("\n")
            if runs:
                edge = np.zeros(len(lines) + 1, np.int64)
                at = np.array([r["line"] for r in runs])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + np.array([r["size"] for r in runs]), -1)
                cut = (np.cumsum(edge[:-1]) > 0).tolist()
                kept = [x for x, c in zip(lines, cut, strict=True) if not c]
            else:
                kept = lines
            n.append(len(lines))
            gone.append(len(lines) - len(kept))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])


def remove_line_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text of each row.

    A line goes if it is in a run of min_lines equal lines or more that starts at an earlier place too: in a row with a smaller
    doc_id (then hash of the text) or further up in the same row. Lines are parted by \\n; a null or empty text is one empty
    line. Rows that repeat id and text are at the same place, so they don't remove each other. Null ids come after all others.
    An empty table gives an empty result. doc_id is an integer; columns but doc_id and text are not read.
    """
    runs = later_copies(docs, min_lines).groupBy("doc", "h").agg(F.collect_set(F.struct("line", "size")).alias("runs"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"), F.xxhash64("text").alias("h"))
    joined = keyed.join(runs, ["doc", "h"], "left").select("doc_id", "text", "runs")
    return joined.transform(in_arrow, _kept, "doc_id long, n_lines long, n_removed long, kept_text string")


def digest(removed: DataFrame) -> DataFrame:
    """kept_text as a lowercase hex SHA-256 of its UTF-8 bytes."""
    return removed.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
