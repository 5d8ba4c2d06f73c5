"""Exact removal of repeated word windows by super-k-mer partitioning.

The minimiser of a window of WINDOW words is the least hash among its GRAM-grams. Consecutive windows of a document that
share one travel as one packed string to the bucket of the minimiser, where equal windows must meet. There windows are
sorted by a hash, and neighbours of one hash are compared word by word, each word by 128 bits and its length.

Within a step of documents windows are compared before anything is sent: one that a smaller doc_id of the step has too
is decided, so of a passage with a third of all rows each step sends it once. Minimisers that are in more than one
of HOT windows (such as where a very frequent passage begins, after ever other words) don't gather in a bucket: their
windows travel singly, to buckets by a hash of the whole window, and in two rounds. The first deals the copies of a window that
the steps send over salted parts of its bucket and leaves the least doc_id of each part undecided, the second compares those. So
neither round has more copies of one window in a task than about the square root of the number of steps. Packed strings of one
step and bucket group are one compressed row.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bytewords import Splitter, Words, mixed
from corpusloom.llm.common import WORD, bound_batches, in_arrow, materialise, worker_state

WINDOW, GRAM = 13, 2
#: A minimiser is hot when it has more than one in so many of all windows; so no more than this many are.
HOT = 2_000
#: Windows in a group of buckets, about, and groups at most.
GROUP_WINDOWS, GROUPS = 1 << 20, 1 << 20
#: Windows in a step, about: the salts of the first round follow from it.
STEP_WINDOWS = 1 << 18
#: Of the compression of what is sent.
LEVEL = 6
#: Null ids come after all others.
LAST = np.iinfo(np.int64).max


def rolled(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all k-grams of word hashes."""
    n = len(h) - k + 1
    out = np.full(max(n, 0), seed, np.uint64)
    if n > 0:
        m = mixed(h + np.uint64(seed))
        for i in range(k):
            out = out * np.uint64(0x100000001B3) + m[i : n + i]
    return mixed(out)


def minimisers(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: the hash of its minimiser and the place of that, the first of equals."""
    g = rolled(h, gram, 0x51ED)
    width = window - gram + 1
    n = len(g) - width + 1
    least, at = g[:n].copy(), np.arange(n)
    for i in range(1, width):
        better = g[i : n + i] < least
        least = np.where(better, g[i : n + i], least)
        at = np.where(better, np.arange(i, n + i), at)
    return least, at


class Step:
    """Windows of a step's documents, laid end to end."""

    def __init__(self, w: Words, ids: np.ndarray, texts: np.ndarray, window: int, gram: int, full: bool = True):
        self.words, self.ids, self.texts = w, ids, texts
        h = w.hashes[0]
        n = max(0, len(h) - window + 1)
        self.at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :]) if n else np.zeros(0, np.int64)  # within one document
        self.doc = w.doc[self.at]
        if not len(self.at):
            self.place, self.least, self.h1, self.h2 = np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(3))
            return
        least, place = minimisers(h, window, gram)
        self.least, self.place = least[self.at], place[self.at]
        if full:
            self.h1, self.h2 = rolled(h, window, 0xA5A5)[self.at], rolled(w.hashes[1], window, 0xC3C3)[self.at]

    def decided(self) -> np.ndarray:
        """Windows that a document with a smaller id in this step has too."""
        out = np.zeros(len(self.at), bool)
        if not len(out):
            return out
        order = np.argsort(self.h1)
        h1, h2, ids = self.h1[order], self.h2[order], self.ids[self.doc[order]]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        heads = np.flatnonzero(new)
        if len(heads) < len(order):
            out[order] = ids > np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.append(heads, len(order))))
        return out


def steps(batches, window: int, gram: int, full: bool = True):
    """Steps of batches of (doc_id, hash of the text, text)."""
    split = worker_state("splitter_2", Splitter) if full else worker_state("splitter_1", lambda: Splitter(hashes=1))
    for batch in batches:
        ids = batch.column(0).fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        texts = batch.column(1).to_numpy(zero_copy_only=False)
        for w in split(batch.column(2)):
            yield Step(w, ids[w.first : w.first + w.rows], texts[w.first : w.first + w.rows], window, gram, full)


def _heavy(batches, window: int, gram: int):
    """Minimisers that are frequent within a step, with their counts; the count of all windows under the key 0."""
    for s in steps(batches, window, gram, full=False):
        keys, n = np.unique(s.least, return_counts=True)
        often = n >= max(2, len(s.at) // (2 * HOT))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(n[often], len(s.at)))], ["key", "n"])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays and their types as one compressed string."""
    import zstandard

    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 1 + 10 * raw[0], []
    for i in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, 1 + 10 * i)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def pack_by_group(group, ids, texts, start, n, cut):
    """Rows (bucket group, data) of strings with ascending bucket groups."""
    heads = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])).tolist()
    for x, y in zip(heads, [*heads[1:], len(group)], strict=True):
        yield int(group[x]), pack(ids[x:y], texts[x:y], start[x:y].astype(np.int32), n[x:y].astype(np.int32), np.frombuffer(b" ".join(cut[x:y]), np.uint8))


def _super_kmers(batches, hot, groups: int, salts: int, window: int, gram: int):
    """Rows (bucket group, data): packed strings, and under groups below 0 the windows that are decided already.

    Groups from `groups` on hold single windows: group * salts + salt of the step.
    """
    hot, task = hot.value, TaskContext.get().partitionId()
    for i_step, s in enumerate(steps(batches, window, gram)):
        w, gone = s.words, s.decided()
        out_group, out_data = [], []
        if gone.any():
            at = np.flatnonzero(gone)
            doc = s.doc[at]
            out_group.append(-1 - int(s.ids[doc[0]] % 1024))
            out_data.append(pack(s.ids[doc], s.texts[doc], s.at[at] - w.begin[doc]))
        keep = np.flatnonzero(~gone)
        if len(keep):
            single = np.isin(s.least[keep], hot) if len(hot) else np.zeros(len(keep), bool)
            place = np.where(single, -1 - keep, s.place[keep])
            # adjoining windows of one place are one string
            a = np.flatnonzero(np.concatenate([[True], (np.diff(s.at[keep]) != 1) | (np.diff(place) != 0)]))
            n = np.diff(np.append(a, len(keep)))
            first = keep[a]
            bucket = np.where(single[a], mixed(s.h1[first] ^ s.h2[first]), mixed(s.least[first]))
            group = (bucket % np.uint64(groups)).astype(np.int64)
            salt = int(mixed(np.array([(task << 32) + i_step], np.uint64))[0] % np.uint64(salts))
            group = np.where(single[a], groups + group * salts + salt, group)
            order = np.argsort(group, kind="stable")
            group, first, n = group[order], first[order], n[order]
            doc, at = s.doc[first], s.at[first]
            start, raw = at - w.begin[doc], w.raw.tobytes()
            cut = [raw[i:j] for i, j in zip(w.start[at].tolist(), w.end[at + n + window - 2].tolist(), strict=True)]
            for g, data in pack_by_group(group, s.ids[doc], s.texts[doc], start, n, cut):
                out_group.append(g)
                out_data.append(data)
        for i in range(0, len(out_group), 64):
            yield pa.RecordBatch.from_arrays([pa.array(out_group[i : i + 64], pa.int64()), pa.array(out_data[i : i + 64], pa.binary())], ["group", "data"])


def repeated(parts: list[list[np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, text, at) of the windows in a group of buckets that a document with a smaller id has too."""
    return compared(parts, window)[0]


def compared(parts: list[list[np.ndarray]], window: int):
    """(doc, text, at) of the windows in a group of buckets that a document with a smaller id has too; and (doc, text, at, bytes) of the others, on call."""
    doc, text, start, n = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(4))
    split, found, size = worker_state("splitter_2", Splitter), [], 0
    for p in parts:
        w = split.step(p[4], np.array([0, len(p[4])]), 0)
        found.append((*w.hashes, (w.end - w.start).astype(np.int32), w.start + size))
        size += len(p[4])
    a, b, length, byte = (np.concatenate(x) for x in zip(*found, strict=True))
    begin = np.cumsum(n + window - 1) - (n + window - 1)
    whose = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[whose] + inner
    h = rolled(a, window, 0x7F4A)[at]
    order = np.argsort(h)
    hs = h[order]
    new = np.ones(len(order), bool)
    new[1:] = hs[1:] != hs[:-1]
    same = np.flatnonzero(~new)  # equal hashes: the words must be equal too
    odd = np.zeros(len(same), bool)
    p, q = at[order[same]], at[order[same - 1]]
    for i in range(window):
        odd |= (a[p + i] != a[q + i]) | (b[p + i] != b[q + i]) | (length[p + i] != length[q + i])
    if odd.any():  # different windows of one hash: sort by the words themselves
        order = np.lexsort([x[at + i] for i in range(window) for x in (a, b, length)])
        new[1:] = False
        for i in range(window):
            for x in (a, b, length):
                new[1:] |= x[at[order[1:]] + i] != x[at[order[:-1]] + i]
    heads = np.flatnonzero(new)
    ds = doc[whose[order]]
    later = ds > np.repeat(np.minimum.reduceat(ds, heads), np.diff(np.append(heads, len(order)))) if len(order) else np.zeros(0, bool)
    rows = lambda x: (doc[whose[x]], text[whose[x]], start[whose[x]] + inner[x])

    def others():
        x, raw = order[~later], b"".join(p[4].tobytes() for p in parts)
        last = at[x] + window - 1
        return *rows(x), [raw[i:j] for i, j in zip(byte[at[x]].tolist(), (byte[last] + length[last]).tolist(), strict=True)]

    return rows(order[later]), others


def by_document(doc: np.ndarray, text: np.ndarray, at: np.ndarray):
    """A batch with the windows of each document as runs (begin, end), in one array."""
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], ["doc", "text_hash", "runs"])
    order = np.lexsort((at, text, doc))
    doc, text, at = doc[order], text[order], at[order]
    cut = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(text) != 0)])
    head = np.concatenate([[True], cut[1:] | (np.diff(at) > 1)])
    a = np.flatnonzero(head)
    b = np.append(a[1:], len(doc)) - 1
    docs = np.flatnonzero(cut[a])
    flat = np.stack([at[a], at[b] + 1], 1).reshape(-1).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(docs, len(a)) * 2, pa.int32()), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(doc[a][docs]), pa.array(text[a][docs]), lists], ["doc", "text_hash", "runs"])


def _verdicts(batches, groups: int, salts: int, window: int):
    """Windows to remove, from the rows of a task, which are in ascending order of groups; and of groups from `groups` on, packed, the windows left for the second round."""

    def out(found, left=()):
        known = found.num_rows
        group, data = [g for g, _ in left], [d for _, d in left]
        none = lambda kind: pa.nulls(len(left), kind)
        columns = [pa.concat_arrays([x, none(x.type)]) for x in found.columns]
        columns += [pa.concat_arrays([pa.nulls(known, kind), pa.array(x, kind)]) for kind, x in ((pa.int64(), group), (pa.binary(), data))]
        return pa.RecordBatch.from_arrays(columns, ["doc", "text_hash", "runs", "group", "data"])

    def done(group, held):
        gone, others = compared(held, window)
        if group < groups:
            return out(by_document(*gone))
        doc, text, at, cut = others()
        same = np.full(len(doc), (group - groups) // salts)
        return out(by_document(*gone), list(pack_by_group(same, doc, text, at, np.ones(len(doc), np.int32), cut)))

    group, held = None, []
    for batch in batches:
        for g, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = unpack(data.as_py())
            if g < 0:
                yield out(by_document(*part))
                continue
            if g != group and held:
                yield done(group, held)
                held = []
            group = g
            held.append(part)
    if held:
        yield done(group, held)


def _squeezed(batches):
    """Texts compressed one by one: they are shuffled once, to meet what goes of them."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        data = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["row", "data"])


def _removed(batches, window: int):
    import zstandard

    loose = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        n, gone, digests = [], [], []
        for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ws = WORD.findall(loose(data).decode("utf-8", "surrogatepass")) if data else []
            if spans:
                hit = np.zeros(len(ws) + 1, np.int32)
                for run in spans:
                    r = np.array(run, np.int64).reshape(-1, 2)
                    np.add.at(hit, r[:, 0], 1)
                    np.add.at(hit, np.minimum(r[:, 1] + window - 1, len(ws)), -1)
                hit = np.cumsum(hit[:-1]) > 0
                kept = [w for w, x in zip(ws, hit.tolist(), strict=True) if not x]
            else:
                kept = ws
            n.append(len(ws))
            gone.append(len(ws) - len(kept))
            digests.append((" ".join(kept)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["row", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, groups: int | None = None, salts: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space) of each row.

    A word is removed if a window of `window` words covers it that also starts in a document with a smaller doc_id; windows
    are judged on the input. Null and empty texts have no words, shorter ones no window. Rows of one doc_id don't remove
    each other; null ids count as larger than all others. An empty table gives an empty result. doc_id is an integer;
    columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    gram = min(gram, window)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    heavy = texts.transform(in_arrow, lambda it: _heavy(it, window, gram), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    heavy = materialise(heavy, "window-counts")
    total = (heavy.filter("key = 0").agg(F.max("n")).first()[0]) or 0
    hot = [r.key for r in heavy.filter((F.col("key") != 0) & (F.col("n") > max(64, total // HOT))).collect()]
    held = spark.sparkContext.broadcast(np.array(hot, np.int64).view(np.uint64))
    if groups is None:
        groups = min(GROUPS, max(64, -(-total // GROUP_WINDOWS)))
    if salts is None:
        salts = max(1, math.isqrt(total // STEP_WINDOWS))
    bound_batches(spark)
    packed = texts.transform(in_arrow, lambda it: _super_kmers(it, held, groups, salts, window, gram), "group long, data binary")
    rows = "doc long, text_hash long, runs array<int>, group long, data binary"
    judge = lambda df: df.repartition("group").sortWithinPartitions("group").transform(in_arrow, lambda it: _verdicts(it, groups, salts, window), rows)
    first = materialise(judge(packed), "window-first")
    second = judge(first.filter("data is not null").select("group", "data"))
    found = first.filter("data is null").unionByName(second)
    found = found.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_h")).agg(F.collect_list("runs").alias("_runs"))
    found = materialise(found, "window-verdicts")
    row = F.struct("doc_id", F.coalesce("doc_id", F.lit(int(LAST))).alias("_doc"), F.col("h").alias("_h")).alias("row")
    keyed = texts.select(row, "text").transform(in_arrow, _squeezed, "row struct<doc_id:bigint,_doc:bigint,_h:bigint>, data binary").select("row.*", "data")
    joined = keyed.join(found, ["_doc", "_h"], "left").select("doc_id", "data", "_runs")
    out = joined.transform(in_arrow, lambda it: _removed(it, window), "doc_id long, n_words long, n_removed long, kept_text string")
    return out


def digest(removed: DataFrame) -> DataFrame:
    """kept_text as a lowercase hex SHA-256 of its UTF-8 bytes."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
