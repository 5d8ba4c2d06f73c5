"""Schemas of the stored tables and of results, and the open vocabularies."""

from pyspark.sql import types as T

KINDS = ("class", "method", "note", "directory", "module", "project", "doc")
EDGE_KINDS = ("calls", "imports", "contains", "mentions")
SOURCES = ("facts", "llm", "docs")
FACT_KINDS = ("class", "method")
ROLLUP_KINDS = ("directory", "module", "project")
FACT_EDGES = ("calls", "imports", "contains")
VERSION = 1

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


#: The retrieval unit; (repo, path, kind, symbol) is its key, id a hash of that.
FRAGMENT = _struct(
    ("id", _L, False), ("repo", _S, False), ("path", _S, False), ("kind", _S, False), ("symbol", _S, True), ("signature", _S, True),
    ("line_start", _I, True), ("line_end", _I, True), ("lang", _S, True), ("source", _S, True), ("content", _S, True),
    ("embedding", T.ArrayType(T.FloatType()), True), ("content_hash", _S, True), ("updated_at", T.TimestampType(), True),
)
#: dst_id is set for contains and mentions, dst_symbol for the others and for what contains could not resolve.
EDGE = _struct(("repo", _S, False), ("src_id", _L, False), ("dst_id", _L, True), ("dst_symbol", _S, True), ("kind", _S, False))
RESULT_COLUMNS = ("repo", "path", "kind", "symbol", "signature", "line_start", "line_end", "content")
SECTION = T.StructType([
    T.StructField("heading_path", T.ArrayType(_S)), T.StructField("level", _I), T.StructField("text", _S), T.StructField("has_table", T.BooleanType()),
    T.StructField("part", _I), T.StructField("parts", _I), T.StructField("symbol", _S),
])
JAVA_FRAGMENT = _struct(("kind", _S, False), ("symbol", _S, False), ("signature", _S, True), ("line_start", _I, True), ("line_end", _I, True), ("content", _S, True))
JAVA_EDGE = _struct(("src_symbol", _S, False), ("dst_symbol", _S, False), ("kind", _S, False))
JAVA_INDEX = _struct(("kind", _S, False), ("symbol", _S, False), ("detail", _S, True))
