import pytest
from pyspark.sql import functions as F

from corpusloom.functions import expr as E


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("  a \t b  c  ", "a b c"), ("a\n\n\n\nb", "a\n\nb"), ("　a\u0085", "a"), ("\x1ca\x1f", "a"), ("", "")])
def test_clean(spark, raw, want):
    assert one(spark, E.clean_text("x"), x=raw) == want


@pytest.mark.parametrize(("name", "want"), [("OrderServiceImpl", True), ("IOTools", True), ("Order", False), ("orderService", False), ("SLA", False), ("", False), (None, False)])
def test_linkable(spark, name, want):
    assert one(spark, E.is_linkable("x"), x=name) is want


@pytest.mark.parametrize(("path", "want"), [("a/b/c", ["", "a", "a/b", "a/b/c"]), ("a", ["", "a"]), ("", [""])])
def test_ancestors(spark, path, want):
    assert one(spark, E.ancestors("x"), x=path) == want


@pytest.mark.parametrize(("path", "want"), [("a/b", "a"), ("a", ""), ("", None)])
def test_parent(spark, path, want):
    assert one(spark, E.parent_dir("x"), x=path) == want


def test_names(spark):
    assert one(spark, E.simple_name("x"), x="a.b.C") == "C"
    assert one(spark, E.type_symbol("x"), x="C.run") == "C"
    assert one(spark, E.owner("x"), x="C.run") == "C"


@pytest.mark.parametrize(("title", "want"), [("Refund rules (v2)!", "7-refund-rules-v2"), ("", "7"), ("???", "7"), ("x" * 59 + " y z", "7-" + "x" * 59)])
def test_slug(spark, title, want):
    assert one(spark, E.slug(F.lit("7"), "x"), x=title) == want


def test_embed_input(spark):
    assert one(spark, E.embed_input("x"), x=" \n ") == "(empty)"
    assert len(one(spark, E.embed_input("x"), x="y" * 9000)) == 8000


def test_thinking_is_cut(spark):
    assert one(spark, E.strip_think("x"), x="<think>a\nb</think>\n c <think>d</think>e") == "c e"
    assert one(spark, E.strip_directive("x"), x="do it\n/no_think \n") == "do it"


def test_digest_ignores_order_and_sees_content(spark):
    d = lambda rows: spark.createDataFrame([(rows,)], "c array<struct<kind:string,name:string,body:string>>").select(E.inputs_digest(F.lit("m"), "c")).first()[0]
    a, b = ("class", "A", "x"), ("class", "B", "y")
    assert d([a, b]) == d([b, a]) != d([a, ("class", "B", "z")])


def test_boilerplate(spark):
    judge = lambda name, sig, body="", **k: one(spark, E.is_boilerplate("s", "g", "c", **k), s=name, g=sig, c=body)
    assert judge("A.getX", "int getX()") and judge("A.toString", "String toString()") and judge("A.x", "int x()", "int x() { return x; }")
    assert not judge("A.total", "int total(boolean isActive)")
    assert judge("A.total", "int total(boolean isActive)", compat=True)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(E.cosine_distance("a", "b")).collect()]
    assert got[0] == 1.0 and abs(got[1]) < 1e-9 and got[2] is None and got[3] is None
