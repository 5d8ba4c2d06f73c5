"""Named queries on the driver tables, and the DuckDB SQL that says the same.

A document stands for a fragment: repo = source, path = lang/doc_id, content = text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import expr as E
from corpusloom.operators import relational as R
from corpusloom.operators import tree as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _probe(spark, sf_dir: str, vec_id: int = 7) -> list[float]:
    """The vector of one row: what an embedded query is to the engine."""
    return _t(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("distance", 6).alias("distance"))


_NEAR = """
SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS distance
FROM embeddings {where} ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), vec_id LIMIT 10
"""


@query(_NEAR.format(where=""))
def topk_cosine(spark, sf_dir):
    return _rounded(R.nearest(_t(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 10, "vec_id"))


@query(_NEAR.format(where="WHERE label = 3"))
def topk_scoped(spark, sf_dir):
    return _rounded(R.nearest(_t(spark, sf_dir, "embeddings").where("label = 3"), _probe(spark, sf_dir), 10, "vec_id"))


@query(_NEAR.format(where="WHERE label <> 3"))
def topk_excluding_source(spark, sf_dir):
    return _rounded(R.nearest(_t(spark, sf_dir, "embeddings").where("label <> 3"), _probe(spark, sf_dir), 10, "vec_id"))


@query("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def embed_dim_check(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, length(x) AS n_sent, sha256(x) AS sent_sha256 FROM (
  SELECT doc_id, CASE WHEN s = '' THEN '(empty)' ELSE substr(s, 1, 8000) END AS x FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS s FROM documents))
""")
def embed_sanitize(spark, sf_dir):
    x = E.embed_input("text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("n_sent"), E.content_hash(x).alias("sent_sha256"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", E.content_hash("text").alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_fragments(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.groupBy(E.content_hash("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'changed' END AS state, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash
FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0
""")
def incremental_delta(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    existing = docs.where("doc_id % 3 <> 0").select("doc_id", E.content_hash("text").alias("content_hash"))
    batch = docs.select("doc_id", E.content_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    todo = R.changed(batch, existing, ["doc_id"])
    known = existing.select(F.col("doc_id").alias("_doc"))
    return todo.join(known, todo["doc_id"] == known["_doc"], "left").select("doc_id", F.when(F.col("_doc").isNull(), "new").otherwise("changed").alias("state"), "content_hash")


@query("""
WITH existing AS (SELECT doc_id AS k, n_chars AS v, 0 AS seq FROM documents WHERE doc_id % 2 = 0),
batch AS (SELECT k, v, seq FROM (SELECT doc_id // 3 AS k, n_chars + 1 AS v, doc_id AS seq, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id DESC) AS n FROM documents WHERE doc_id % 2 = 1 OR doc_id % 7 <> 0) WHERE n = 1)
SELECT k, v, seq FROM batch UNION ALL SELECT k, v, seq FROM existing WHERE k NOT IN (SELECT k FROM batch)
""")
def upsert_snapshot(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    existing = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("v"), F.lit(0).cast("long").alias("seq"))
    batch = docs.where("doc_id % 2 = 1 OR doc_id % 7 <> 0").select(F.floor(F.col("doc_id") / 3).alias("k"), (F.col("n_chars") + 1).alias("v"), F.col("doc_id").alias("seq"))
    return R.upsert(existing, R.last_write(batch, ["k"], "seq"), ["k"])


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem e WHERE l_orderkey % 4 <> 0
UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber % 2 = 1
UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber % 2 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 1)
""")
def prune_sections(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return R.pruned(lines, lines.where("l_orderkey % 4 = 0 AND l_linenumber % 2 = 1"), ["l_orderkey"], ["l_linenumber"])


@query("""
SELECT l_orderkey AS src_id, l_partkey AS dst_id, count(*) AS n FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') AND l_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1, 2
""")
def edge_cascade(spark, sf_dir):
    left = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    return R.cascade(edges, left).groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, length(x) AS n, sha256(x) AS clean_sha256 FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\x{00A0}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM documents)
""")
def clean_text(spark, sf_dir):
    x = E.clean_text("text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("n"), E.content_hash(x).alias("clean_sha256"))


@query("""
SELECT doc_id, i AS part, parts, CASE WHEN parts > 1 THEN '(untitled) [' || i || '/' || parts || ']' ELSE '(untitled)' END AS symbol, sha256(substr(text, (i - 1) * 4000 + 1, 4000)) AS part_sha256
FROM (SELECT doc_id, text, greatest(1, (length(text) + 3999) // 4000) AS parts, unnest(range(1, greatest(1, (length(text) + 3999) // 4000) + 1)) AS i FROM documents)
""")
def hard_split_parts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    parts = F.greatest(F.lit(1), F.ceil(F.length("text") / 4000)).cast("long")
    cut = docs.select("doc_id", "text", parts.alias("parts"), F.explode(F.sequence(F.lit(1).cast("long"), parts)).alias("part"))
    body = F.substring("text", ((F.col("part") - 1) * 4000 + 1).cast("int"), F.lit(4000))
    return cut.select("doc_id", "part", "parts", E.section_symbol(F.array().cast("array<string>"), "part", "parts").alias("symbol"), E.content_hash(body).alias("part_sha256"))


@query("SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents) GROUP BY 1")
def identifier_tokens(spark, sf_dir):
    tokens = _t(spark, sf_dir, "documents").select("doc_id", F.explode(E.identifiers("text")).alias("token"))
    each = tokens.groupBy("token", "doc_id").agg(F.count("*").alias("k"))
    return each.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


_CAMEL = "(SELECT DISTINCT upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS symbol FROM part)"


@query(f"""
SELECT symbol FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS symbol FROM documents UNION SELECT symbol FROM {_CAMEL})
WHERE regexp_matches(symbol, '^[A-Z]') AND regexp_matches(symbol, '[a-z]') AND len(regexp_extract_all(symbol, '[A-Z][a-z0-9]*')) >= 2
""")
def linkable_symbols(spark, sf_dir):
    tokens = _t(spark, sf_dir, "documents").select(F.explode(F.array_distinct(E.identifiers("text"))).alias("symbol"))
    word = lambda i: F.split_part(F.col("p_name"), F.lit(" "), F.lit(i))
    hump = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))
    names = _t(spark, sf_dir, "part").select(F.concat(hump(word(1)), hump(word(2))).alias("symbol"))
    return tokens.unionByName(names).where(E.is_linkable("symbol")).distinct()


_MENTIONS = """
WITH names AS (SELECT min(p_partkey) AS item_id, symbol FROM (SELECT p_partkey, upper(w[1][1]) || w[1][2:] || upper(w[2][1]) || w[2][2:] AS symbol FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)) GROUP BY 2),
named AS (SELECT p_partkey, upper(w[1][1]) || w[1][2:] || upper(w[2][1]) || w[2][2:] AS symbol FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)),
pairs AS (SELECT DISTINCT l_orderkey AS doc_id, item_id, symbol FROM lineitem JOIN named ON l_partkey = p_partkey JOIN names USING (symbol))
"""


def _part_names(spark, sf_dir):
    """p_partkey and a class name made of the first two words of its name."""
    word = lambda i: F.split_part(F.col("p_name"), F.lit(" "), F.lit(i))
    hump = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))
    return _t(spark, sf_dir, "part").select("p_partkey", F.concat(hump(word(1)), hump(word(2))).alias("symbol"))


def _mentions(spark, sf_dir):
    """The link pass over a document for each order, whose text names the classes of its parts; and the classes."""
    named, repo = _part_names(spark, sf_dir), F.lit("r").alias("repo")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(named, "p_partkey")
    docs = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("symbol")), lambda x: F.concat(F.lit("the order takes a "), x, F.lit("."))), "\n").alias("content"))
    classes = named.groupBy("symbol").agg(F.min("p_partkey").alias("id")).select("id", repo, "symbol")
    return R.mention_edges(docs.select("id", repo, "content"), classes), classes


@query(_MENTIONS + "SELECT doc_id, item_id, symbol FROM pairs")
def doc_mentions(spark, sf_dir):
    edges, classes = _mentions(spark, sf_dir)
    return edges.join(classes.withColumnRenamed("id", "dst_id"), "dst_id").select(F.col("src_id").alias("doc_id"), F.col("dst_id").alias("item_id"), "symbol")


@query(_MENTIONS + "SELECT doc_id AS src_id, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS mentions FROM pairs GROUP BY 1")
def mentions_by_doc(spark, sf_dir):
    return R.mentions_by_doc(*_mentions(spark, sf_dir)).select("src_id", F.array_join("mentions", ",").alias("mentions"))


_LINKS = "SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS dst_symbol FROM pages"


def _links(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("dst_symbol"))


@query(f"SELECT page_id, dst_symbol FROM ({_LINKS})")
def page_link_edges(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "dst_symbol").distinct()


@query(f"SELECT url AS path, CAST(page_id AS INTEGER) AS line, 'page' || page_id AS symbol FROM ({_LINKS}) WHERE dst_symbol = 'de'")
def find_usages(spark, sf_dir):
    edges = _links(spark, sf_dir).select(F.col("page_id").alias("src_id"), "dst_symbol", F.lit("calls").alias("kind")).distinct()
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.col("page_id").cast("int").alias("line_start"), F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("symbol"))
    return R.usages(edges, pages, "links.de", None)


@query("""
SELECT DISTINCT CAST(d.p_partkey AS VARCHAR) AS path, d.p_name AS symbol FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN part d ON d.p_name = split_part(p.p_brand || '.' || p.p_name, '.', 2)
WHERE l.l_suppkey = 1
""")
def get_deps(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    lines = _t(spark, sf_dir, "lineitem").where("l_suppkey = 1").select("l_suppkey", F.col("l_partkey").alias("p_partkey"))
    edges = lines.join(part, "p_partkey").select((-1 - F.col("l_suppkey")).alias("src_id"), F.concat_ws(".", "p_brand", "p_name").alias("dst_symbol"), F.lit("imports").alias("kind"))
    classes = part.select(F.col("p_partkey").alias("id"), F.lit("r").alias("repo"), F.lit("class").alias("kind"), F.col("p_name").alias("symbol"), F.col("p_partkey").cast("string").alias("path"))
    source = _t(spark, sf_dir, "supplier").where("s_suppkey = 1").select((-1 - F.col("s_suppkey")).alias("id"), F.lit("r").alias("repo"), F.lit("class").alias("kind"), F.lit("Source").alias("symbol"), F.lit("-").alias("path"))
    return R.dependencies(edges, classes.unionByName(source), "Source.run", None)


@query(_MENTIONS + """
, linked AS (SELECT DISTINCT doc_id, 0 AS tier, doc_id AS rank FROM pairs WHERE symbol = (SELECT min(symbol) FROM pairs)),
semantic AS (SELECT o_orderkey AS doc_id, 1 AS tier, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
SELECT doc_id, tier FROM (SELECT * FROM linked UNION ALL SELECT * FROM semantic WHERE doc_id NOT IN (SELECT doc_id FROM linked)) ORDER BY tier, rank LIMIT 10
""")
def linked_then_semantic(spark, sf_dir):
    edges, classes = _mentions(spark, sf_dir)
    first = classes.join(edges.select(F.col("dst_id").alias("id")), "id", "left_semi").orderBy("symbol").limit(1)
    linked = edges.join(F.broadcast(first.select(F.col("id").alias("dst_id"))), "dst_id", "left_semi").select(F.col("src_id").alias("doc_id"), F.col("src_id").alias("rank")).distinct()
    top = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice").orderBy(F.desc("o_totalprice"), "doc_id").limit(10)
    semantic = top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "doc_id")).cast("long").alias("rank"))
    return R.tiered(linked, semantic, ["doc_id"], ["rank"], 10).select("doc_id", "tier")


def _line_spans(spark, sf_dir):
    """Each document as one span over all its lines, and each line as a span of its own."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    whole = docs.select("doc_id", F.lit("doc").alias("kind"), F.lit(1).alias("line_start"), F.size("lines").alias("line_end"), F.lit("").alias("symbol"))
    each = docs.select("doc_id", F.posexplode("lines").alias("i", "body")).select("doc_id", F.lit("line").alias("kind"), (F.col("i") + 1).alias("line_start"), (F.col("i") + 1).alias("line_end"), E.content_hash("body").alias("symbol"))
    return whole.unionByName(each)


@query("""
SELECT doc_id, CASE WHEN len(l) = 1 THEN NULL ELSE 'line' END AS kind, CAST(2 AS INTEGER) AS line_start, CAST(2 AS INTEGER) AS line_end, sha256(l[2]) AS symbol
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 2 AND NOT (len(l) = 1)
""")
def smallest_covering_span(spark, sf_dir):
    return R.covering_span(_line_spans(spark, sf_dir), 2, ["doc_id"], "kind", "symbol").select("doc_id", "kind", "line_start", "line_end", "symbol")


@query("""
SELECT source AS path, doc_id, coalesce(n_lines, -1) AS n_lines FROM (
  SELECT source, doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(len(string_split(text, chr(10))) AS INTEGER) END AS n_lines,
    row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 4 = 0 THEN NULL ELSE len(string_split(text, chr(10))) END ASC NULLS LAST, doc_id) AS n FROM documents) WHERE n = 1
""")
def file_first_fragment(spark, sf_dir):
    lines = F.when(F.col("doc_id") % 4 != 0, F.size(F.split("text", "\n")))
    spans = _t(spark, sf_dir, "documents").select(F.col("source").alias("path"), "doc_id", lines.alias("line_start"))
    return R.covering_span(spans, None, ["path"], "doc_id").select("path", "doc_id", F.coalesce("line_start", F.lit(-1)).alias("n_lines"))


_PATH = "regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '')"


def _page_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")
    return _t(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(f"SELECT split_part({_PATH}, '/', 1) AS area, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, area LIMIT 40")
def module_map(spark, sf_dir):
    return R.area_counts(_page_paths(spark, sf_dir).withColumn("kind", F.lit("class")))


@query(f"""
WITH p AS (SELECT string_split({_PATH}, '/') AS s FROM pages)
SELECT CASE WHEN i = 0 THEN '' ELSE array_to_string(s[1:i], '/') END AS dir, count(*) AS n FROM (SELECT s, unnest(range(0, len(s))) AS i FROM p) GROUP BY 1
""")
def ancestor_dirs(spark, sf_dir):
    return _page_paths(spark, sf_dir).select(F.explode(E.ancestors(E.parent_dir("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def _deep_dirs(spark, sf_dir):
    """A deep tree: the digits of an order's key as nested directories, below two links that hold nothing else."""
    digits = F.regexp_replace(F.col("o_orderkey").cast("string"), "(.)", "/$1")
    orders = R.dealt(_t(spark, sf_dir, "orders").select("o_orderkey"), F.floor(F.col("o_orderkey") / 1000))  # neighbours share their ancestors
    return orders.select(F.concat(F.lit("a/b"), digits).alias("dir"))


_TREE = """
WITH leaves AS (SELECT 'a/b' || regexp_replace(CAST(o_orderkey AS VARCHAR), '(.)', '/\\1', 'g') AS dir FROM orders),
ups AS (SELECT DISTINCT CASE WHEN i = 0 THEN '' ELSE array_to_string(s[1:i], '/') END AS dir FROM (SELECT s, unnest(range(0, len(s) + 1)) AS i FROM (SELECT string_split(dir, '/') AS s FROM leaves))),
own AS (SELECT dir, count(*) AS n FROM leaves GROUP BY 1),
kids AS (SELECT CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END AS dir, count(*) AS k FROM ups WHERE dir <> '' GROUP BY 1),
marked AS (SELECT u.dir, coalesce(o.n, 0) AS leaves, coalesce(k.k, 0) AS children, u.dir = 'a' AS is_module FROM ups u LEFT JOIN own o USING (dir) LEFT JOIN kids k USING (dir)),
kept AS (SELECT * FROM marked WHERE dir = '' OR is_module OR leaves > 0 OR children <> 1)
"""


def _kept_dirs(spark, sf_dir):
    return T.collapsed(T.directories(_deep_dirs(spark, sf_dir)), spark.createDataFrame([("a",)], "dir string"))


@query(_TREE + """
, above AS (SELECT dir, CASE WHEN i = 0 THEN '' ELSE array_to_string(s[1:i], '/') END AS up FROM (SELECT dir, s, unnest(range(0, len(s))) AS i FROM (SELECT dir, string_split(dir, '/') AS s FROM kept WHERE dir <> ''))),
nearest AS (SELECT above.dir, max(up) AS parent FROM above JOIN kept b ON b.dir = up GROUP BY 1)
SELECT a.dir, a.leaves, parent FROM kept a LEFT JOIN nearest USING (dir)
""")
def collapse_chains(spark, sf_dir):
    return _kept_dirs(spark, sf_dir).select("dir", "leaves", "parent")


@query(_TREE + "SELECT CASE WHEN dir = '' THEN 'project' WHEN is_module THEN 'module' ELSE 'directory' END AS kind, count(*) AS n FROM kept GROUP BY 1")
def dir_kind_tiers(spark, sf_dir):
    return _kept_dirs(spark, sf_dir).groupBy(E.dir_kind("dir", "is_module").alias("kind")).agg(F.count("*").alias("n"))


@query(_TREE + "SELECT dir, row_number() OVER (ORDER BY CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END DESC, dir) AS rank FROM kept")
def rollup_order(spark, sf_dir):
    return T.bottom_up(_kept_dirs(spark, sf_dir)).select("dir", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT r_name, sha256('model=none' || chr(10) || string_agg('note' || chr(9) || n_name || chr(9) || CAST(n_nationkey AS VARCHAR), chr(10) ORDER BY n_name)) AS digest
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def rollup_digest(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    child = F.struct(F.lit("note").alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("body"))
    return n.groupBy("r_name").agg(F.collect_list(child).alias("c")).select("r_name", E.inputs_digest(F.lit("none"), "c").alias("digest"))


@query("""
WITH c AS (SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name || '/' || n_name AS dir, 'directory' AS kind, CAST(n AS BIGINT) AS total FROM c
UNION ALL SELECT r_name, 'module', CAST(sum(n) AS BIGINT) FROM c GROUP BY 1 UNION ALL SELECT '', 'project', CAST(sum(n) AS BIGINT) FROM c
""")
def hierarchical_rollup(spark, sf_dir):
    nations = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    leaves = counts.join(F.broadcast(nations), "n_nationkey").select(F.concat_ws("/", "r_name", "n_name").alias("dir"), "n")
    return T.totals_up(leaves, "dir", "n").select("dir", E.dir_kind("dir", E.depth("dir") == 1).alias("kind"), "total")


_METHODS = """
(SELECT p_partkey AS id, 'C' || (p_partkey % 50) AS cls,
  CASE p_partkey % 5 WHEN 0 THEN 'getName' WHEN 1 THEN 'C' || (p_partkey % 50) WHEN 2 THEN 'toString' WHEN 3 THEN 'amount' ELSE 'total' || p_size END AS name,
  CASE p_partkey % 5 WHEN 3 THEN 'long amount() { return amount; }' ELSE 'void x() { a(); b(); }' END AS content FROM part)
"""


def _methods(spark, sf_dir):
    c = F.col("p_partkey")
    cls = F.concat(F.lit("C"), (c % 50).cast("string"))
    name = F.when(c % 5 == 0, "getName").when(c % 5 == 1, cls).when(c % 5 == 2, "toString").when(c % 5 == 3, "amount").otherwise(F.concat(F.lit("total"), F.col("p_size").cast("string")))
    body = F.when(c % 5 == 3, "long amount() { return amount; }").otherwise("void x() { a(); b(); }")
    return _t(spark, sf_dir, "part").select(c.alias("id"), cls.alias("cls"), F.concat_ws(".", cls, name).alias("symbol"), F.concat(F.lit("long "), name, F.lit("()")).alias("signature"), body.alias("content"))


def _substantive(spark, sf_dir):
    return _methods(spark, sf_dir).where(~E.is_ctor("symbol", "cls") & ~E.is_boilerplate("symbol", "signature", "content"))


@query(f"""
SELECT id, name = cls AS ctor, name IN ('equals', 'hashCode', 'toString') OR regexp_matches(name, '^(get|set|is)[A-Z0-9_]')
  OR regexp_matches(content, '\\)\\s*(?:throws [\\w., ]+)?\\{{\\s*return\\s+[\\w.]+\\s*;\\s*\\}}\\s*$') AS boilerplate FROM {_METHODS}
""")
def boilerplate_gate(spark, sf_dir):
    return _methods(spark, sf_dir).select("id", E.is_ctor("symbol", "cls").alias("ctor"), E.is_boilerplate("symbol", "signature", "content").alias("boilerplate"))


@query(f"""
SELECT cls, sha256('model=none' || chr(10) || 'bodies=False' || chr(10) || 'class ' || cls || chr(10) || string_agg('long ' || name || '()', chr(10) ORDER BY 'long ' || name || '()')) AS facts_key
FROM {_METHODS} WHERE name LIKE 'total%' GROUP BY cls
""")
def facts_key(spark, sf_dir):
    units = _substantive(spark, sf_dir).groupBy("cls").agg(F.collect_list("signature").alias("facts"))
    return units.select("cls", E.content_hash(E.facts_key(F.lit("none"), F.lit("False"), F.concat(F.lit("class "), "cls"), "facts")).alias("facts_key"))


@query(r"""
WITH t AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages),
s AS (SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '^-+|-+$', '', 'g') AS s FROM t)
SELECT page_id, CASE WHEN s = '' THEN CAST(page_id AS VARCHAR) ELSE page_id || '-' || s END AS slug FROM s
""")
def page_slug(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", E.slug("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("""
WITH k AS (SELECT page_id, page_id % 5 AS v FROM pages WHERE page_id % 3 <> 0), s AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 9 ELSE page_id % 5 END AS v FROM pages WHERE page_id % 4 <> 0)
SELECT coalesce(k.page_id, s.page_id) AS page_id, CASE WHEN s.v IS NULL THEN 'remove' WHEN k.v IS NOT DISTINCT FROM s.v THEN 'skip' ELSE 'write' END AS action FROM k FULL OUTER JOIN s ON k.page_id = s.page_id
""")
def version_diff(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    known = pages.where("page_id % 3 <> 0").select("page_id", (F.col("page_id") % 5).alias("version"))
    seen = pages.where("page_id % 4 <> 0").select("page_id", F.when(F.col("page_id") % 7 == 0, F.lit(9)).otherwise(F.col("page_id") % 5).alias("version"))
    return R.version_diff(known, seen)


@query("SELECT doc_id, round(n_chars / 4.0 / 2048, 2) AS fill, n_chars / 4.0 >= 0.8 * 2048 AS pressure FROM documents")
def context_pressure(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", E.context_fill("n_chars", F.lit(2048)).alias("fill"), E.under_pressure("n_chars", F.lit(2048)).alias("pressure"))


@query("SELECT conv_id, turn, sha256(regexp_replace('<think>' || chr(10) || role || '</think> ' || chr(10) || text, '(?s)<think>.*?</think>\\s*', '', 'g')) AS answer_sha256 FROM conversations")
def strip_think(spark, sf_dir):
    said = F.concat(F.lit("<think>\n"), F.col("role"), F.lit("</think> \n"), F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", E.content_hash(E.strip_think(said)).alias("answer_sha256"))


@query("SELECT repo, count(*) AS files, count(*) FILTER (WHERE n_chars > 4000) AS oversize, count(*) FILTER (WHERE text IS NULL OR text = '') AS skipped FROM (SELECT source AS repo, n_chars, text FROM documents) GROUP BY 1")
def run_stats(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(
        F.count("*").alias("files"), F.count_if(F.col("n_chars") > 4000).alias("oversize"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("skipped"))


@query()
def html_sections(spark, sf_dir):
    from corpusloom.functions import udtf

    return udtf.html_sections(_t(spark, sf_dir, "pages"), "page_id", "html")


@query("""
SELECT p_partkey, p_name AS symbol, true AS has_table, 'html' AS format, CAST(16 + len(p_brand) + len(CAST(p_size AS VARCHAR)) AS INTEGER) AS n_chars FROM part
UNION ALL SELECT p_partkey, p_name, true, 'md', CAST(38 + len(p_brand) + len(CAST(p_size AS VARCHAR)) AS INTEGER) FROM part
""")
def html_tables_md(spark, sf_dir):
    """Pages with a table each, built of parts: as HTML, and as the markdown that says the same."""
    from corpusloom.functions import udtf

    part = R.dealt(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    c = F.concat
    rows = part.select("p_partkey", c(F.lit("<h1>"), "p_name", F.lit("</h1><table><tr><th>Brand</th><th>Size</th></tr><tr><td>"), "p_brand", F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>")).alias("html"))
    md = part.select("p_partkey", c(F.lit("# "), "p_name", F.lit("\n\n| Brand | Size |\n| --- | --- |\n| "), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n")).alias("md"))
    a = udtf.html_sections(rows, "p_partkey", "html").select("p_partkey", "symbol", "has_table", F.lit("html").alias("format"), F.length("text").alias("n_chars"))
    b = udtf.markdown_sections(md, "p_partkey", "md").select("p_partkey", "symbol", "has_table", F.lit("md").alias("format"), F.length("text").alias("n_chars"))
    return a.unionByName(b)


@query("""
WITH c AS (SELECT 'p/Part' || p_partkey || '.java' AS path, 'Part' || p_partkey AS t FROM part)
SELECT path, 'class' AS kind, t AS symbol, 'public class ' || t AS detail FROM c
UNION ALL SELECT path, 'method', t || '.total', 'public int total(int n)' FROM c
UNION ALL SELECT path, 'imports', t, 'q.Part0' FROM c
UNION ALL SELECT path, 'contains', t, t || '.total' FROM c
UNION ALL SELECT path, 'calls', t || '.total', unnest(['scale', 'length']) FROM c
""")
def java_index(spark, sf_dir):
    """Classes generated from parts, parsed to fragments and edges."""
    from corpusloom.functions import udtf

    c, name = F.concat, F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    source = c(F.lit("package p;\nimport q.Part0;\npublic class "), name, F.lit(" {\n  private int size = "), F.col("p_size").cast("string"), F.lit(";\n  /* void no() {} */\n  public int total(int n) {\n    return scale(n) + \"x();\".length();\n  }\n}\n"))
    part = R.dealt(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    files = part.select(c(F.lit("p/"), name, F.lit(".java")).alias("path"), source.alias("text"))
    return udtf.java_index(files, "path", "text")
