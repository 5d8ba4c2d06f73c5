from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import udtf
from corpusloom.sources import java

SOURCE = '''package shop;

import shop.model.Item;
import static java.util.Collections.sort;
import java.io.*;

/** class Fake { void no() {} } */
@Named("x{")
public class Cart<T extends Item> implements Iterable<T> {
    private final List<T> items = new ArrayList<>() {{ add(null); }};
    static int count = start(1), other;

    public Cart(int n) { super(); resize(n); }

    @Override
    public Iterator<T> iterator() {
        Runnable r = new Runnable() { public void run() { tick(); } };
        return items.stream().filter(x -> ok(x)).iterator();
    }

    String text() { return """
        { "not": call() } \\n""" + "}"; }

    abstract void later(String s) throws IOException;

    enum Size { SMALL(1) { int v() { return f(); } }, BIG; int w() { return 2; } }
    record Pair(int a, int b) { Pair { check(a); } int sum() { return add(a, b); } }
    interface Shape { double area(); default void draw() { if (area() > 0) paint(); } }
}
'''


def test_declarations():
    got = {f["symbol"]: f for f in java.fragments(SOURCE)}
    assert {"Cart", "Cart.Cart", "Cart.iterator", "Cart.text", "Cart.later", "Size", "Size.w", "Pair", "Pair.sum", "Shape", "Shape.area", "Shape.draw"} <= set(got)
    assert "Fake" not in got and "Cart.resize" not in got
    assert got["Cart"]["signature"] == '@Named("x{") public class Cart<T extends Item> implements Iterable<T>' == got["Cart"]["content"]
    assert got["Cart.iterator"]["signature"] == "@Override public Iterator<T> iterator()"
    assert (got["Cart.iterator"]["line_start"], got["Cart.iterator"]["line_end"]) == (15, 19)
    assert got["Shape.area"]["signature"].startswith("double area()")


def test_fields():
    assert java.fields(SOURCE)["Cart"] == ["private final List<T> items = new ArrayList<>() {{ add(null); }};", "static int count = start(1), other;"]


def test_edges():
    got = [(e["src_symbol"], e["dst_symbol"], e["kind"]) for e in java.edges(SOURCE)]
    assert [x for x in got if x[2] == "imports"] == [("Cart", "shop.model.Item", "imports"), ("Cart", "java.util.Collections.sort", "imports"), ("Cart", "java.io", "imports")]
    calls = {x[:2] for x in got if x[2] == "calls"}
    assert {("Cart.Cart", "resize"), ("Cart.iterator", "stream"), ("Cart.iterator", "filter"), ("Cart.iterator", "ok"), ("Pair.sum", "add"), ("Shape.draw", "paint"), ("Shape.draw", "area")} <= calls
    assert not {c for _, c in calls} & {"ArrayList", "Runnable", "if", "call", "super"}


def test_nothing():
    assert java.fragments("") == [] and java.edges("import a.B;") == [] and java.fragments(None) == []


def test_unfinished_source_ends():
    for cut in range(0, len(SOURCE), 17):
        java.fragments(SOURCE[:cut])
        java.edges(SOURCE[:cut])


def test_fragments_take_the_scans_tokens(monkeypatch):
    found, want = java.scan(SOURCE), java.fragments(SOURCE)
    monkeypatch.setattr(java, "tokens", None)
    assert java.fragments(SOURCE, found) == want


def test_index_is_fragments_and_edges_of_one_scan(spark):
    files = spark.createDataFrame([("a", SOURCE), ("b", "class A { void f() { g(); g(); } }"), ("c", None), (None, "import x.Y;")], "path string, text string")
    got = udtf.java_index(files, "path", "text")
    frags = udtf.java_fragments(files, "path", "text").select("path", "kind", "symbol", F.col("signature").alias("detail"))
    edges = udtf.java_edges(files, "path", "text").select("path", "kind", F.col("src_symbol").alias("symbol"), F.col("dst_symbol").alias("detail"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(frags.unionByName(edges))
    assert [tuple(r) for r in got.where("path = 'b' AND kind = 'calls'").collect()] == [("b", "calls", "A.f", "g")]


def one_row_group(spark, path, rows=2000):
    """A part table in one row group, which one task reads."""
    spark.range(rows).selectExpr("id AS p_partkey", "'old plate' AS p_name", "'Brand#1' AS p_brand", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_files_are_parsed_by_many_tasks(spark, tmp_path):
    got = catalog.QUERIES["java_index"](spark, one_row_group(spark, tmp_path))
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) <= 6 * 2000 / 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
