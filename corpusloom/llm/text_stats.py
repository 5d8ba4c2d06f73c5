"""Counts over whole texts that the quality operators judge by."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import WORD, bound_batches, in_arrow

SYMBOLS = "#*$%&|<>"
#: Words from which repeated windows are found by sorting ranks, not by a set of tuples.
LONG = 50_000
WINDOW = 5
_SMALL = re.compile(r"\b\w{1,3}\b")

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps_words", "n_short_words", "n_marks", "n_distinct_words", "n_digits")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words covered by a window that is found twice or more in the text, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if len(words) < LONG:
        grams = list(zip(*(words[i:] for i in range(window)), strict=False))
        if len(set(grams)) == n:
            return 0
        seen, twice = set(), set()
        for g in grams:
            (twice if g in seen else seen).add(g)
        hit = np.fromiter((g in twice for g in grams), bool, n)
    else:
        ids: dict[str, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        rank = a[:n]
        for i in range(1, window):
            rank = np.unique(rank * len(ids) + a[i : n + i], return_inverse=True)[1]
        hit = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def counts(text: str) -> tuple[int, ...]:
    """FIELDS of one text."""
    words = WORD.findall(text)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words), text.count("\n") + 1,
        sum(map(str.isupper, words)), sum(len(w) < 4 for w in words), text.count("!") + text.count("|"), len(set(words)), sum(map(text.count, "0123456789")),
    )


def _batches(batches):
    for batch in batches:
        rows = [counts(t or "") for t in batch.column(1).to_pylist()]
        columns = np.array(rows, np.int64).reshape(-1, len(FIELDS)).T
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["row", *FIELDS])


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of each row and FIELDS of its text; a null text counts as empty."""
    from pyspark.sql import functions as F

    bound_batches(docs.sparkSession)
    row = F.struct(*keep).alias("row")
    kind = docs.select(row).dtypes[0][1]
    out = docs.select(row, "text").transform(in_arrow, _batches, f"row {kind}, " + ", ".join(f"{f} long" for f in FIELDS))
    return out.select("row.*", *FIELDS)
