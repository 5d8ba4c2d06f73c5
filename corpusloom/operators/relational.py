"""Top-k, graph joins, span lookup, maps: the operators behind the retrieval API, as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import expr as E


def scoped(df: DataFrame, repo: str | None, default: str | None = None, column: str = "repo") -> DataFrame:
    """Rows of one repository: the argument, else the configured default, else all."""
    wanted = repo or default
    return df.where(F.col(column) == F.lit(wanted)) if wanted else df


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows dealt to many tasks by their keys, before a step that costs much for each row: a file's row group is else read, and worked on, by one task.

    The number is given outright, since adaptive execution joins tasks by the bytes they read, which are few here. Keys should tell rows apart.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def nearest(df: DataFrame, vector: list[float], limit: int, *ties: str, column: str = "embedding") -> DataFrame:
    """The `limit` rows of least cosine distance, exactly, with `distance`; nulls last, ties by the columns `ties`.

    Sorting and limit together are a TakeOrderedAndProject: each task keeps `limit` rows, so nothing is shuffled but these.
    """
    at = F.array(*[F.lit(float(x)) for x in vector])
    return df.withColumn("distance", E.cosine_distance(F.col(column), at)).orderBy(F.col("distance").asc_nulls_last(), *ties).limit(limit)


def usages(edges: DataFrame, fragments: DataFrame, symbol: str, limit: int | None = 50) -> DataFrame:
    """path, line, symbol of the methods that call a simple name."""
    name = symbol.rsplit(".", 1)[-1]
    calls = edges.where((F.col("kind") == "calls") & (F.col("dst_symbol") == name)).select("src_id")
    found = calls.join(fragments.select(F.col("id").alias("src_id"), "path", "line_start", "symbol"), "src_id")
    out = found.select("path", F.col("line_start").alias("line"), "symbol").orderBy("path", F.col("line").asc_nulls_last(), "symbol")
    return out.limit(limit) if limit is not None else out


def dependencies(edges: DataFrame, fragments: DataFrame, symbol: str, limit: int | None = 50, columns: tuple[str, ...] = ("path", "symbol")) -> DataFrame:
    """Classes of the same repository that a class imports, by the last part of the imported name; external ones drop out."""
    name = symbol.split(".", 1)[0]
    source = fragments.where((F.col("kind") == "class") & (F.col("symbol") == name)).select(F.col("id").alias("src_id"), F.col("repo").alias("src_repo"))
    wanted = source.join(edges.where("kind = 'imports'").select("src_id", "dst_symbol"), "src_id").select("src_repo", E.simple_name("dst_symbol").alias("name")).distinct()
    deps = fragments.where("kind = 'class'")
    found = deps.join(wanted, (deps["repo"] == wanted["src_repo"]) & (deps["symbol"] == wanted["name"])).select(*[deps[c] for c in columns]).distinct()
    out = found.orderBy(*[F.col(c).asc_nulls_last() for c in columns])
    return out.limit(limit) if limit is not None else out


def mention_edges(docs: DataFrame, symbols: DataFrame, text: str = "content") -> DataFrame:
    """(src_id, dst_id) of documents and the symbols they name. docs: id, repo, text; symbols: id, repo, symbol.

    Identifiers are made distinct within a document before the join, and only those a symbol has go on: the
    symbols are joined as a set of names, so a frequent word costs one row per document at most.
    """
    tokens = docs.select(F.col("id").alias("src_id"), "repo", F.explode(F.array_distinct(E.identifiers(text))).alias("symbol"))
    named = symbols.where(E.is_linkable("symbol")).select(F.col("id").alias("dst_id"), "repo", "symbol")
    return tokens.join(named, ["repo", "symbol"]).select("src_id", "dst_id").distinct()


def mentions_by_doc(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """src_id and the sorted distinct symbols it mentions. classes: id, symbol."""
    named = edges.join(classes.select(F.col("id").alias("dst_id"), "symbol"), "dst_id")
    return named.groupBy("src_id").agg(F.array_sort(F.collect_set("symbol")).alias("mentions"))


def tiered(first: DataFrame, second: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first table's rows, then the second's that the first doesn't have by `keys`; each by its `order`, in all `limit`."""
    both = first.withColumn("tier", F.lit(0)).unionByName(second.withColumn("tier", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("tier", *order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("tier", *order).limit(limit)


def covering_span(spans: DataFrame, line: int | Column | None, keys: list[str], *ties: str) -> DataFrame:
    """Of each key the smallest span over `line`, or without a line the first by its start; nulls last."""
    here = spans
    if line is not None:
        here = spans.where((F.col("line_start") <= line) & (F.col("line_end") >= line))
        by = [(F.col("line_end") - F.col("line_start")).asc_nulls_last()]
    else:
        by = [F.col("line_start").asc_nulls_last()]
    w = Window.partitionBy(*keys).orderBy(*by, *ties)
    return here.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def area_counts(fragments: DataFrame, limit: int = 40) -> DataFrame:
    """area, n: fragments by top-level directory, the largest first."""
    return fragments.where(~F.col("kind").isin("doc", "note")).groupBy(E.top_area("path").alias("area")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area").limit(limit)


def last_write(batch: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of each key: the last by `order`."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """existing with batch's rows in place of those of the same keys (null equals null)."""
    b = batch.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda x, y: x & y, [existing[k].eqNullSafe(b[f"_{k}"]) for k in keys])
    return existing.join(b, same, "left_anti").unionByName(batch)


def changed(batch: DataFrame, existing: DataFrame, keys: list[str], hash_column: str = "content_hash") -> DataFrame:
    """batch's rows that are new or have another hash than existing has."""
    known = existing.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(hash_column).alias("_hash"))
    same = reduce(lambda x, y: x & y, [batch[k].eqNullSafe(known[f"_{k}"]) for k in keys])
    return batch.join(known, same & batch[hash_column].eqNullSafe(known["_hash"]), "left_anti")


def pruned(existing: DataFrame, live: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """existing without rows whose scope is in `live` while their scope and keys are not; scopes that live doesn't have stay as they are."""
    seen = live.select(*[F.col(k).alias(f"_{k}") for k in scope]).distinct()
    full = live.select(*[F.col(k).alias(f"_{k}") for k in [*scope, *keys]]).distinct()
    on = lambda other, names: reduce(lambda a, b: a & b, [existing[k].eqNullSafe(other[f"_{k}"]) for k in names])
    return existing.join(seen, on(seen, scope), "left_anti").unionByName(existing.join(full, on(full, [*scope, *keys]), "left_semi"))


def cascade(edges: DataFrame, fragments: DataFrame) -> DataFrame:
    """Edges whose ends still exist."""
    ids = fragments.select(F.col("id").alias("_id"))
    from_ = edges.join(ids, edges["src_id"] == ids["_id"], "left_semi")
    free = from_.where("dst_id IS NULL")
    bound = from_.where("dst_id IS NOT NULL")
    return free.unionByName(bound.join(ids, bound["dst_id"] == ids["_id"], "left_semi"))


def version_diff(known: DataFrame, seen: DataFrame) -> DataFrame:
    """page_id and action (write, skip, remove), from (page_id, version) known before and seen now."""
    k = known.select("page_id", F.col("version").alias("old"))
    s = seen.select("page_id", F.col("version").alias("new"))
    action = F.when(F.col("new").isNull(), "remove").when(F.col("old").eqNullSafe(F.col("new")), "skip").otherwise("write")
    return k.join(s, "page_id", "full_outer").select("page_id", action.alias("action"))
