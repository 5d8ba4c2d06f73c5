"""Parsers as table functions over DataFrames: rows in, rows of sections, fragments or edges out, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import models, schema
from corpusloom.sources import java, sections


def table_function(df: DataFrame, keys: list[str], column: str, parse: Callable[[str], Iterable[dict]], shape: T.StructType) -> DataFrame:
    """Each row's keys with each record that `parse` makes of its `column`; a null is parsed as empty."""
    out = T.StructType([df.schema[k] for k in keys] + list(shape.fields))
    names = [f.name for f in out.fields]

    def run(batches):
        for pdf in batches:
            rows = [(*key, *(r[f.name] for f in shape.fields)) for *key, text in pdf.itertuples(index=False, name=None) for r in parse("" if text is None else text)]
            yield pd.DataFrame(rows, columns=names)

    return df.select(*keys, column).mapInPandas(run, out)


def html_sections(df: DataFrame, key: str, column: str, max_chars: int = sections.MAX_CHARS) -> DataFrame:
    return table_function(df, [key], column, lambda t: (s.row() for s in sections.parse_html(t, max_chars)), schema.SECTION)


def markdown_sections(df: DataFrame, key: str, column: str, max_chars: int = sections.MAX_CHARS) -> DataFrame:
    return table_function(df, [key], column, lambda t: (s.row() for s in sections.parse_markdown(t, max_chars)), schema.SECTION)


def java_fragments(df: DataFrame, key: str, column: str) -> DataFrame:
    return table_function(df, [key], column, java.fragments, schema.JAVA_FRAGMENT)


def _java_edges(text: str, found: java.Scan) -> Iterable[dict]:
    """A file's edges, each once."""
    types = {d.symbol for d in found.declarations if d.kind == "class"}
    inside = [{"src_symbol": d.symbol.rsplit(".", 1)[0], "dst_symbol": d.symbol, "kind": "contains"} for d in found.declarations if d.kind == "method" and d.symbol.rsplit(".", 1)[0] in types]
    return {tuple(e.values()): e for e in [*java.edges(text, found), *inside]}.values()


def java_edges(df: DataFrame, key: str, column: str) -> DataFrame:
    """imports, calls, and what types contain: a method whose owner is a type of the same file. An edge comes once for each file."""
    return table_function(df, [key], column, lambda text: _java_edges(text, java.scan(text)), schema.JAVA_EDGE)


def java_index(df: DataFrame, key: str, column: str) -> DataFrame:
    """kind, symbol, detail of a file's fragments (with their signatures) and edges (with their other ends), by one scan of each file."""

    def parse(text):
        found = java.scan(text)
        yield from ({"kind": f["kind"], "symbol": f["symbol"], "detail": f["signature"]} for f in java.fragments(text, found))
        yield from ({"kind": e["kind"], "symbol": e["src_symbol"], "detail": e["dst_symbol"]} for e in _java_edges(text, found))

    return table_function(df, [key], column, parse, schema.JAVA_INDEX)


def embed_text(model):
    """A Pandas UDF that embeds a column with a model of corpusloom.models."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(models.embed(model, texts.tolist()))

    return embed
