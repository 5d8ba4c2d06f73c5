"""Directory trees against link-by-link removal, and how much one task reads."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tree as T


def by_links(leaves, modules):
    """dir, leaves, parent, is_module by taking out links one at a time."""
    parent = {"": None}
    for d in leaves:
        parts = d.split("/") if d else []
        for i in range(1, len(parts) + 1):
            parent["/".join(parts[:i])] = "/".join(parts[: i - 1])
    while True:
        link = next((d for d in parent if d and d not in modules and d not in leaves and sum(p == d for p in parent.values()) == 1), None)
        if link is None:
            return {(d, leaves.count(d), p, d in modules) for d, p in parent.items()}
        child = next(c for c, p in parent.items() if p == link)
        parent[child] = parent.pop(link)


def frame(spark, dirs):
    return spark.createDataFrame([(d,) for d in dirs], "dir string")


def run(spark, leaves, modules):
    return [tuple(r) for r in T.collapsed(T.directories(frame(spark, leaves)), frame(spark, modules)).select("dir", "leaves", "parent", "is_module").collect()]


@pytest.mark.parametrize("seed", range(8))
def test_collapse_is_removal_link_by_link(spark, seed):
    r = random.Random(seed)
    leaves = ["/".join(r.choice("abc"[: 1 + seed % 3]) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 14))]
    modules = sorted({"/".join(d.split("/")[: r.randint(1, 5)]) for d in leaves if d} - {""})[: seed % 4] + ["not/there"]
    got = run(spark, leaves, modules)
    assert len(got) == len(set(got)) and set(got) == by_links(leaves, modules)


def test_names_that_start_alike_and_odd_paths(spark):
    assert set(run(spark, ["a/x", "ab/x/y", None], [])) == {("", 0, None, False), ("a/x", 1, "", False), ("ab/x/y", 1, "", False)}
    assert set(run(spark, ["/x/y", "q//z"], ["q/"])) == {("", 0, None, False), ("/x/y", 1, "", False), ("q/", 0, "", True), ("q//z", 1, "q/", False)}
    assert run(spark, [], ["a"]) == []


def test_collapse_with_hashes_that_collide(spark):
    leaves = ["a/b/c", "a/b/d", "e/f/g", "e/f/g/h", "i"]
    same = T.directories(frame(spark, leaves)).withColumn("least", F.lit(0).cast("long"))
    assert {tuple(r) for r in T.collapsed(same, frame(spark, ["e"])).select("dir", "leaves", "parent", "is_module").collect()} == by_links(leaves, ["e"])


def test_no_row_meets_the_root(spark):
    """Of a tree of 3000 leaves, no task's join or window gets a row for each leaf."""
    leaves = spark.range(3000).select(F.concat(F.lit("top/d"), F.col("id").cast("string")).alias("dir"))
    kept = T.collapsed(T.directories(leaves), frame(spark, ["top"]))
    assert kept.count() == 3002
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    groups = T.directories(leaves).groupBy("below", "least").count().agg(F.max("count")).first()[0]
    assert groups <= 2
