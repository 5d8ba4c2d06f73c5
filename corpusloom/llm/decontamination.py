"""Benchmark decontamination by winnowing.

Of the hashes of all K-grams of words in each run of WIDTH of them the least is kept, in benchmark items and documents
alike. A span of K + WIDTH - 1 = WINDOW words that both have holds WIDTH K-grams, so both keep the same one: joining
the kept fingerprints misses no shared window. Each joined pair is extended to both sides word by word; runs of
WINDOW words at least are hits. Items of fewer words are looked up whole.

Only the benchmark's own words have numbers, every other word of a document is 0 and ends any run. The benchmark is
taken in blocks of at most BLOCK_WORDS words, so what is sent to the executors has a bound, however large it is.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bound_batches, in_arrow, unique_column

WINDOW, K = 8, 5
WIDTH = WINDOW - K + 1
#: Items' words in a block.
BLOCK_WORDS = 2_000_000
#: Items with hits from which a document is contaminated.
LEAST_ITEMS = 2
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    """Words of letters, digits and whatever isn't ASCII, A-Z lower-cased."""
    text = text or ""
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of word numbers."""
    n = len(ids) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    m = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + m[i : n + i]
    return mixed(out)


def winnow(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Places of the least hash of each run of `width` hashes, the last of equals. A shorter run counts as one."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(width, n)
    runs = n - width + 1
    least, at = hashes[:runs].copy(), np.arange(runs)
    for i in range(1, width):
        later = hashes[i : runs + i]
        better = later <= least
        least = np.where(better, later, least)
        at = np.where(better, np.arange(i, runs + i), at)
    return np.unique(at)


class Index:
    """Fingerprints of a block of benchmark items: (item_id as text, words)."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.vocabulary: dict[str, int] = {}
        self.names: list[list[str]] = []  # of items with the same words, all
        self.short: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        number = self.vocabulary.setdefault
        same: dict[tuple[int, ...], int] = {}
        long, prints = [], defaultdict(list)
        for name, ws in items:
            ids = tuple(number(w, len(self.vocabulary) + 1) for w in ws)
            if not ids:
                continue
            if ids in same:
                self.names[same[ids]].append(name)
                continue
            no = same[ids] = len(self.names)
            self.names.append([name])
            if len(ids) < window:
                self.short[len(ids)][ids] = no
            else:
                long.append((no, np.array(ids, np.int64)))
        flat, self.start, at = [], {}, 1
        for no, ids in long:
            self.start[no] = at
            for p in winnow(h := gram_hashes(ids, k), window - k + 1):
                prints[int(h[p])].append((no, at + int(p)))
            flat += [ids, np.zeros(1, np.int64)]
            at += len(ids) + 1
        self.flat = np.concatenate([np.zeros(1, np.int64), *flat]) if flat else np.zeros(1, np.int64)
        self.prints = dict(prints)
        self.keys = np.array(sorted(prints), np.uint64)

    def search(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of the document's words that are hit, and the numbers of the items that occur."""
        spans, items = [], set()
        if len(ids) >= self.window and len(self.keys):
            h = gram_hashes(ids, self.k)
            at = winnow(h, self.window - self.k + 1)
            place = np.searchsorted(self.keys, h[at])
            place[place == len(self.keys)] = 0
            done: dict[int, int] = {}
            for p in at[self.keys[place] == h[at]].tolist():
                for no, q in self.prints[int(h[p])]:
                    line = q - p
                    if done.get(line, -1) > p or ids[p] == 0:
                        continue
                    a, b = self.extend(ids, p, q)
                    done[line] = max(b, p + 1)
                    if b - a >= self.window:
                        spans.append((a, b))
                        items.add(no)
        for n, known in self.short.items():
            first = {x[0] for x in known}
            for p in np.flatnonzero(np.isin(ids[: len(ids) - n + 1], list(first))).tolist() if len(ids) >= n else ():
                if (no := known.get(tuple(ids[p : p + n].tolist()))) is not None:
                    spans.append((p, p + n))
                    items.add(no)
        return spans, items

    def extend(self, ids: np.ndarray, p: int, q: int) -> tuple[int, int]:
        """The longest run of equal words around p in the document and q in the items."""
        flat, a, b, shift = self.flat, p, p, q - p
        while a > 0 and ids[a - 1] and ids[a - 1] == flat[a - 1 + shift]:
            a -= 1
        while b < len(ids) and ids[b] and ids[b] == flat[b + shift]:
            b += 1
        return a, b


def _search(batches, index):
    """Of each row: number of words, spans and names of the items. index: a broadcast Index."""
    index = index.value
    get = index.vocabulary.get
    for batch in batches:
        texts = batch.column(1).to_pylist()
        n, starts, ends, names = [], [], [], []
        for t in texts:
            ws = words(t)
            ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
            spans, items = index.search(ids)
            n.append(len(ws))
            starts.append([a for a, _ in spans])
            ends.append([b for _, b in spans])
            names.append([x for i in items for x in index.names[i]])
        longs, texts_ = pa.list_(pa.int64()), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(names, texts_)], ["row", "n_words", "starts", "ends", "items"])


def _digest(batches):
    """Counts covered words and hashes the names of the items, from spans of all blocks."""
    for batch in batches:
        hit, n_items, digests = [], [], []
        for starts, ends, names in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            covered, upto = 0, 0
            for a, b in sorted(zip(starts, ends, strict=True)):
                covered += max(0, b - max(a, upto))
                upto = max(upto, b)
            names = sorted(set(names))
            hit.append(covered)
            n_items.append(len(names))
            digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string())], ["row", "n_hit", "n_items", "items_sha256"])


def _found_at_once(batches, index):
    """_search and _digest in one worker, where there is but one block."""

    def joined():
        for batch in _search(batches, index):
            row = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["row", "n_words"])
            yield pa.RecordBatch.from_arrays([row, *(batch.column(i) for i in (2, 3, 4))], ["row", "starts", "ends", "items"])

    return _digest(joined())


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS):
    """Indexes of blocks of items, one after the other; the driver holds one block."""
    held, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").distinct()
    for r in rows.orderBy("name", "text").toLocalIterator():
        ws = words(r.text)
        held.append((r.name or "", ws))
        n += len(ws)
        if n >= limit:
            yield Index(held)
            held, n = [], 0
    if held:
        yield Index(held)


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, least_items: int = LEAST_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row.

    docs: doc_id, text; benchmark: item_id, text. Null and empty texts have no words; items without words occur nowhere,
    an item_id that repeats counts once, a null one as the empty name. Repeated documents are searched each. Empty
    tables: no rows, or no hits. Other columns are not read. Several blocks of items read the documents once each.
    """
    return _found(docs, benchmark, block_words, least_items).drop("_h64")


def _found(docs: DataFrame, benchmark: DataFrame, block_words: int, least_items: int) -> DataFrame:
    """find_contamination, with the hash of each row's text."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row"), "text")
    kind = texts.dtypes[0][1]
    shape = f"row {kind}, n_words long, starts array<long>, ends array<long>, items array<string>"
    digest = f"row struct<row:{kind},n_words:bigint>, n_hit long, n_items long, items_sha256 string"
    held = [spark.sparkContext.broadcast(x) for x in blocks(benchmark, block_words)] or [spark.sparkContext.broadcast(Index([]))]
    if len(held) == 1:
        out = texts.transform(in_arrow, lambda it: _found_at_once(it, held[0]), digest)
    else:  # rows are told apart by what they are, and repeated rows by their number
        parts = [texts.transform(in_arrow, lambda it, x=x: _search(it, x), shape).withColumn("_block", F.lit(i)) for i, x in enumerate(held)]
        found = (
            functools.reduce(DataFrame.unionByName, parts).groupBy("row", "n_words").agg(
                F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.flatten(F.collect_list("items")).alias("items"),
                F.sum(F.when(F.col("_block") == 0, 1).otherwise(0)).alias("_n"),
            ).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_", "_n")
        )
        out = found.select(F.struct("row", "n_words").alias("row"), "starts", "ends", "items").transform(in_arrow, _digest, digest)
    return out.select(F.col("row.row.doc_id").alias("doc_id"), F.col("row.row.h").alias("_h64"), "row.n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= least_items).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, least_items: int = LEAST_ITEMS) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, each judged by its own text.

    Rows with a null doc_id, and rows of one doc_id with different texts, stay or go each by itself; rows that repeat both go together.
    Null and empty texts stay. Without items all rows stay.
    """
    h = unique_column(docs, "_of_text")
    bad = _found(docs, benchmark, block_words, least_items).filter("contaminated").select(F.col("doc_id").alias("_bad"), F.col("_h64").alias("_bad_h64")).distinct()
    marked = docs.withColumn(h, F.xxhash64("text"))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["_bad"]) & (marked[h] == bad["_bad_h64"]), "left_anti").drop(h)
