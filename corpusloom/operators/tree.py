"""Directory trees: ancestors, collapse of chains in closed form, bottom-up order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import expr as E


def directories(leaves: DataFrame, path: str = "dir") -> DataFrame:
    """dir, leaves, below, least of every directory above a leaf's: its own leaves, those at or below it, the least hash of their directories.

    leaves: one row for each leaf with its directory. The ancestors are exploded within rows and met in one aggregation. A directory and one below
    it hold the same leaves if and only if `below` is equal; then so is `least`, which few others share.
    """
    each = leaves.select(F.col(path).alias("own"), F.xxhash64(path).alias("hash"))
    every = each.select("own", "hash", F.explode(F.array_distinct(E.ancestors("own"))).alias("dir"))
    return every.groupBy("dir").agg(F.count_if(F.col("dir") == F.col("own")).alias("leaves"), F.count("*").alias("below"), F.min("hash").alias("least"))


def collapsed(dirs: DataFrame, modules: DataFrame) -> DataFrame:
    """dir, leaves, parent, is_module of the directories that stay: the root, modules, those with leaves or with other than one child.

    A directory's parent is its nearest ancestor that stays, which is what taking single-child links out one by one comes to. Such links hold the
    leaves of the one directory at their lower end, so a chain meets in one group, which is no longer than a path is deep; above its top stays
    the parent, which holds more. No row meets the root or another directory that all share.
    dirs: what directories() gives. modules: dir.
    """
    marked = dirs.join(modules.select("dir").distinct().withColumn("is_module", F.lit(True)), "dir", "left").withColumn("is_module", F.coalesce("is_module", F.lit(False)))
    stays = (F.col("dir") == "") | F.col("is_module")
    chain = marked.withColumn("chain", F.collect_list(F.struct("dir", stays.alias("stays"))).over(Window.partitionBy("below", "least")))
    holds = lambda up, down: (down != up) & ((up == "") | F.startswith(down, F.concat(up, F.lit("/"))))
    kept = chain.where(stays | ~F.exists("chain", lambda x: holds(F.col("dir"), x["dir"])))
    names = lambda test: F.transform(F.filter("chain", lambda x: holds(x["dir"], F.col("dir")) & test(x)), lambda x: x["dir"])
    top = F.coalesce(F.array_min(names(lambda x: F.lit(True))), "dir")
    near = F.coalesce(F.array_max(names(lambda x: x["stays"])), E.parent_dir(top))
    return kept.select("dir", "leaves", F.when(F.size("chain") == 1, E.parent_dir("dir")).otherwise(near).alias("parent"), "is_module")


def totals_up(leaves: DataFrame, path: str, value: str) -> DataFrame:
    """dir, total: a sum of every directory over all leaves below, by one explode and one aggregation."""
    return leaves.select(F.explode(E.ancestors(path)).alias("dir"), value).groupBy("dir").agg(F.sum(value).alias("total"))


def bottom_up(dirs: DataFrame) -> DataFrame:
    """Rows with a rank, the deepest first, the root last."""
    return dirs.withColumn("rank", F.row_number().over(Window.orderBy(E.depth("dir").desc(), "dir")))
