"""Token ids as compressed binary shards, by an adaptive context-mixing range coder.

A shard holds the ids of consecutive documents, cut into blocks. Each block is coded alone: its model starts anew, and it has
a CRC-32 of its ids and code words. The model predicts an id from the two ids before (order 2) and the one before (order 1), each with a
confidence, and mixes these with the shard's id frequencies (order 0): the pair of confidences picks adaptive weights, so
an id gets the range of a right prediction, or its share of the rest. All blocks of a shard are coded in step, a numpy
lane for each, in whole numbers only, so that coding and decoding agree on every machine; the one division is of whole numbers below
2 ** 48 by others below 2 ** 33, whose quotient IEEE doubles floor exactly.

The coder is carry-less for the decoder: only widths decide when a word is taken, so the encoder just adds up low ends, lets
words with a carry stand, and adds all carries at the end.

Shard layout, little-endian: magic, then unsigned 32-bit version, documents, block length, blocks, size of the largest id + 1;
64-bit ids; then three sections, each with a 64-bit length: document lengths (zstd of uint32), frequencies (zstd of uint32),
blocks (CRC-32 and code length in 16-bit words for each, then all code words). Shards are rows of a Parquet table, so Spark's
writers commit them, on any store, and lost or repeated tasks leave nothing half written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bound_batches, in_arrow, scratch
from corpusloom.llm.token_counts import steps, tokenizer

MAGIC, VERSION = b"CLTK", 2
END_ID = 2
#: Ids of a shard, about; blocks in step at least, if there are enough ids; block lengths.
SHARD_IDS, LANES, BLOCK_LEAST, BLOCK_MOST = 1 << 21, 1024, 256, 4096
#: Bits of a context table's index, of the mixing precision and, at least, of the frequencies' total.
TABLE_BITS, MIX_BITS, FREQ_BITS = 9, 16, 18
#: Weights move by a 2 ** RATE-th towards TOP after a right prediction, else LOW, of 2 ** MIX_BITS.
RATE, TOP, LOW = 4, 63_000, 64
#: A width lies between 2 ** LEAST and 2 ** (LEAST + 16).
LEAST = 32
#: Steps whose contexts are made at once in encoding.
STRIP = 128


def frequencies(ids: np.ndarray, size: int) -> np.ndarray:
    """Counts scaled to a total of a power of two, 2 ** FREQ_BITS or more; each id that occurs has one at least."""
    n = np.bincount(ids, minlength=size).astype(np.int64)
    if not n.sum():
        return n
    have = n > 0
    total = 1 << max(FREQ_BITS, int(2 * have.sum() - 1).bit_length())
    out = np.where(have, np.maximum(1, n * (total - int(have.sum())) // n.sum()), 0)
    out[np.argmax(out)] += total - out.sum()
    return out


class Model:
    """Predictions and weights of `lanes` blocks; arrays [order, lane] hold order 1 first, then order 2.

    A table entry is an id + 1, shifted by 3, and a confidence, which is 0 where nothing was seen yet. A weight entry holds the ranges of the two
    predictions, of 2 ** MIX_BITS: order 2 from bit 32 on, order 1 below. Those of an entry without prediction fall to LOW like
    any prediction that is wrong, so no lane needs a case of its own. Choices are made by masks, 0 or -1: numpy's `where` costs several times as much.
    """

    #: By confidence and, in bit 3, whether the prediction was right: the next confidence, and whether the entry stays.
    NEXT = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7])
    STAYS = np.array([0, 0, *[-1] * 14])
    _HALF = (1 << 32 - RATE) - 1
    FADES = np.array(_HALF << 32 | _HALF)
    MISS = np.array((LOW >> RATE) << 32 | LOW >> RATE)
    HIT2, HIT1 = np.array((TOP >> RATE) - (LOW >> RATE) << 32), np.array((TOP >> RATE) - (LOW >> RATE))
    K1, K2, DROPPED = np.array(2654435761, np.uint32), np.array(2246822519, np.uint32), np.array(32 - TABLE_BITS, np.uint32)
    N1, N3, N7, N8, N32, N63, RATE_, ONES32 = (np.array(i) for i in (1, 3, 7, 8, 32, 63, RATE, (1 << 32) - 1))

    def __init__(self, lanes: int):
        size, states = 1 << TABLE_BITS, 1 << 6
        self.table = np.zeros(2 * lanes * size, np.uint32)
        self.weights = np.full(lanes * states, (1 << (MIX_BITS - 2)) << 32 | 1 << (MIX_BITS - 3), np.int64)
        self.row = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * size
        self.state_row = np.arange(lanes, dtype=np.int64) * states
        self.stored, self.context = np.zeros((2, lanes), np.uint32), np.zeros((2, lanes), np.uint32)
        self.at, self.entry, self.known, self.sure, self.right, self.a = (np.zeros((2, lanes), np.int64) for _ in range(6))
        self.state, self.weight, self.p2, self.p1, self.b = (np.zeros(lanes, np.int64) for _ in range(5))

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        """Sets p2 and p1, the ranges that the predictions known[1] and known[0] get, by the two ids before, + 1."""
        first, second = self.context
        np.multiply(last, self.K1, out=first)
        np.multiply(before, self.K2, out=second)
        np.bitwise_xor(second, first, out=second)
        np.right_shift(self.context, self.DROPPED, out=self.context)
        np.add(self.row, self.context, out=self.at)
        np.take(self.table, self.at, out=self.stored, mode="clip")
        np.copyto(self.entry, self.stored)
        np.right_shift(self.entry, self.N3, out=self.known)
        np.bitwise_and(self.entry, self.N7, out=self.sure)
        np.left_shift(self.sure[1], self.N3, out=self.state)
        np.add(self.state, self.sure[0], out=self.state)
        np.add(self.state, self.state_row, out=self.state)
        np.take(self.weights, self.state, out=self.weight, mode="clip")
        np.right_shift(self.weight, self.N32, out=self.p2)
        np.bitwise_and(self.weight, self.ONES32, out=self.p1)

    def compare(self, x: np.ndarray) -> None:
        """Sets right, a mask, by the ids that came, + 1."""
        right = self.right
        np.bitwise_xor(self.known, x, out=right)
        np.subtract(right, self.N1, out=right)
        np.right_shift(right, self.N63, out=right)

    def learn(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """x: ids that came, + 1, compared before; hit2, hit1: masks of lanes where that was coded as the prediction of order 2 or 1."""
        a, b, entry = self.a, self.b, self.entry
        np.bitwise_and(self.right, self.N8, out=a)
        np.bitwise_or(a, self.sure, out=a)
        np.bitwise_xor(entry, self.sure, out=entry)
        np.left_shift(x, self.N3, out=b)
        np.bitwise_xor(entry, b, out=entry)
        np.bitwise_and(entry, np.take(self.STAYS, a, mode="clip"), out=entry)
        np.bitwise_xor(entry, b, out=entry)
        np.bitwise_or(entry, np.take(self.NEXT, a, mode="clip"), out=entry)
        np.copyto(self.stored, entry, casting="unsafe")
        self.table[self.at] = self.stored
        w = self.weight
        np.right_shift(w, self.RATE_, out=b)
        np.bitwise_and(b, self.FADES, out=b)
        np.subtract(w, b, out=w)
        np.add(w, self.MISS, out=w)
        np.bitwise_and(hit2, self.HIT2, out=b)
        np.add(w, b, out=w)
        np.bitwise_and(hit1, self.HIT1, out=b)
        np.add(w, b, out=w)
        self.weights[self.state] = w


def encode_blocks(ids: np.ndarray, block: int, freq: np.ndarray) -> list[np.ndarray]:
    """The code words of each block of `block` ids; the last one is filled up with its last id."""
    lanes, bits = -(-len(ids) // block), np.array(int(freq.sum()).bit_length() - 1)
    flat = np.full(lanes * block, ids[-1], np.uint32)
    flat[: len(ids)] = ids
    grid = np.zeros((block + 2, lanes), np.uint32)  # ids + 1, after two steps of nothing
    np.add(flat.reshape(lanes, block).T, 1, out=grid[2:])
    begin = np.cumsum(freq) - freq
    model, width = Model(lanes), np.full(lanes, 1 << (LEAST + 16), np.int64)
    # what is settled but for a carry, 16 bits and perhaps one more in each; the rest of the sum of all low ends
    cap = 2 * block + 8
    out, at, value = np.zeros(lanes * cap, np.uint32), np.arange(lanes, dtype=np.int64) * cap, np.zeros(lanes, np.int64)
    hit1, unit, rest = (np.zeros(lanes, np.int64) for _ in range(3))
    span, other, one, two = (np.zeros((2, lanes), np.int64) for _ in range(4))
    low, size = span
    mix, least, n16, n32, n63, head = (np.array(i) for i in (MIX_BITS, 1 << LEAST, 16, 32, 63, -1 << 32))
    t2, p1 = one
    for t in range(block):
        i = t % STRIP
        if i == 0:
            xs = grid[t + 2 : min(block, t + STRIP) + 2].astype(np.int64)
            begins, sizes = begin.take(xs - 1), freq.take(xs - 1)
        x, hit2 = xs[i], model.right[1]
        model.predict(grid[t + 1], grid[t])
        model.compare(x)
        np.greater(hit2, model.right[0], out=hit1)  # 1 where order 1 alone is right
        np.negative(hit1, out=hit1)
        np.right_shift(width, mix, out=unit)
        np.multiply(unit, model.p2, out=t2)
        np.multiply(unit, model.p1, out=p1)
        np.left_shift(unit, mix, out=rest)
        np.add(t2, p1, out=unit)
        np.subtract(rest, unit, out=rest)
        np.right_shift(rest, bits, out=rest)
        np.multiply(begins[i], rest, out=low)
        np.multiply(sizes[i], rest, out=size)
        np.add(low, unit, out=low)
        # low and size are t2 and p1 where order 1 was right, 0 and t2 where order 2 was
        np.bitwise_xor(span, one, out=other)
        np.bitwise_and(other, hit1, out=other)
        np.bitwise_xor(span, other, out=span)
        np.copyto(two[1], t2)
        np.bitwise_xor(span, two, out=other)
        np.bitwise_and(other, hit2, out=other)
        np.bitwise_xor(span, other, out=span)
        np.add(value, low, out=value)
        np.copyto(width, size)
        while np.minimum.reduce(width) < least:
            np.subtract(width, least, out=unit)
            np.right_shift(unit, n63, out=unit)
            np.right_shift(value, n32, out=rest)
            out[at] = rest  # counts once the place moves on
            np.subtract(at, unit, out=at)
            np.bitwise_and(unit, head, out=rest)
            np.bitwise_and(unit, n16, out=unit)
            np.bitwise_and(value, np.invert(rest, out=rest), out=value)
            np.left_shift(value, unit, out=value)
            np.left_shift(width, unit, out=width)
        model.learn(x, hit2, hit1)
    for i in (32, 16, 0):
        out[at] = (value >> i) & (0xFFFF if i < 32 else -1)
        at += 1
    out = out.reshape(lanes, cap)
    at -= np.arange(lanes) * cap
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:, :-1] += carry[:, 1:]
    out = out.astype(np.uint16)
    return [out[i, :n] for i, n in enumerate(at.tolist())]


def decode_blocks(codes: np.ndarray, lengths: np.ndarray, total: int, block: int, freq: np.ndarray) -> np.ndarray:
    """The ids. codes: words of all blocks, one after the other; lengths: words of each."""
    lanes, bits = len(lengths), np.array(int(freq.sum()).bit_length() - 1)
    at = np.cumsum(lengths) - lengths
    codes = np.concatenate([codes, np.zeros(8, np.uint16)])
    # of each slot: the id + 1, where its range begins, and how many slots it has
    slots = np.repeat(np.arange(1, len(freq) + 1) << 42 | (np.cumsum(freq) - freq) << 21 | freq, freq)
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = code << 16 | codes[at]
        at += 1
    grid = np.zeros((block + 2, lanes), np.uint32)
    model, width = Model(lanes), np.full(lanes, 1 << (LEAST + 16), np.int64)
    hit2, hit1, unit, rest, t1, over, slot, found, small = (np.zeros(lanes, np.int64) for _ in range(9))
    span, one, two, other = (np.zeros((3, lanes), np.int64) for _ in range(4))
    (x, low, size), (t2, p1) = span, one[1:]
    part, word = np.zeros(lanes), np.zeros(lanes, np.uint16)
    mix, least, few, n16, n21, n42, n63 = (np.array(i) for i in (MIX_BITS, 1 << LEAST, (1 << 21) - 1, 16, 21, 42, 63))
    for t in range(block):
        model.predict(grid[t + 1], grid[t])
        np.right_shift(width, mix, out=unit)
        np.multiply(unit, model.p2, out=t2)
        np.multiply(unit, model.p1, out=p1)
        np.left_shift(unit, mix, out=rest)
        np.add(t2, p1, out=t1)
        np.subtract(rest, t1, out=rest)
        np.right_shift(rest, bits, out=rest)
        np.subtract(code, t2, out=hit2)
        np.right_shift(hit2, n63, out=hit2)
        np.subtract(code, t1, out=over)
        np.right_shift(over, n63, out=hit1)
        np.bitwise_xor(hit1, hit2, out=hit1)
        np.divide(over, rest, out=part)
        np.copyto(slot, part, casting="unsafe")
        np.take(slots, slot, out=found, mode="clip")
        np.right_shift(found, n42, out=x)
        np.right_shift(found, n21, out=low)
        np.bitwise_and(low, few, out=low)
        np.bitwise_and(found, few, out=size)
        np.multiply(span[1:], rest, out=span[1:])
        np.add(low, t1, out=low)
        # x, low and size are known[0], t2 and p1 where order 1 was right, known[1], 0 and t2 where order 2 was
        np.copyto(one[0], model.known[0])
        np.bitwise_xor(span, one, out=other)
        np.bitwise_and(other, hit1, out=other)
        np.bitwise_xor(span, other, out=span)
        np.copyto(two[0], model.known[1])
        np.copyto(two[2], t2)
        np.bitwise_xor(span, two, out=other)
        np.bitwise_and(other, hit2, out=other)
        np.bitwise_xor(span, other, out=span)
        np.copyto(grid[t + 2], x, casting="unsafe")
        np.subtract(code, low, out=code)
        np.copyto(width, size)
        while np.minimum.reduce(width) < least:
            np.subtract(width, least, out=small)
            np.right_shift(small, n63, out=small)
            np.take(codes, at, out=word, mode="clip")
            np.subtract(at, small, out=at)
            np.bitwise_and(small, word, out=found)
            np.bitwise_and(small, n16, out=small)
            np.left_shift(width, small, out=width)
            np.left_shift(code, small, out=code)
            np.add(code, found, out=code)
        model.compare(x)
        model.learn(x, hit2, hit1)
    return (grid[2:] - np.uint32(1)).T.reshape(-1)[:total]


def _section(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data


def write_shard(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard: the ids of documents of the given lengths."""
    import zstandard

    ids = np.ascontiguousarray(ids, np.uint32)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    size = int(ids.max()) + 1 if len(ids) else 0
    block = int(min(BLOCK_MOST, max(BLOCK_LEAST, -(-len(ids) // LANES))))
    freq = frequencies(ids, size)
    codes = encode_blocks(ids, block, freq) if len(ids) else []
    sums = [zlib.crc32(c.tobytes(), zlib.crc32(ids[i : i + block].tobytes())) for i, c in zip(range(0, len(ids), block), codes, strict=True)]
    table = b"".join(struct.pack("<II", s, len(c)) for s, c in zip(sums, codes, strict=True))
    head = MAGIC + struct.pack("<IIIIIQ", VERSION, len(lengths), block, len(codes), size, len(ids))
    return head + _section(squeeze(np.asarray(lengths, np.uint32).tobytes())) + _section(squeeze(freq.astype(np.uint32).tobytes())) + _section(table + b"".join(c.tobytes() for c in codes))


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of the documents); raises ValueError where a checksum or the layout is wrong."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    version, docs, block, n, _, total = struct.unpack_from("<IIIIIQ", data, 4)
    if version != VERSION:
        raise ValueError(f"token shard of version {version}")
    at, parts = 4 + struct.calcsize("<IIIIIQ"), []
    for _ in range(3):
        (k,) = struct.unpack_from("<Q", data, at)
        parts.append(data[at + 8 : at + 8 + k])
        at += 8 + k
    loose = zstandard.ZstdDecompressor().decompress
    lengths = np.frombuffer(loose(parts[0]), np.uint32)
    freq = np.frombuffer(loose(parts[1]), np.uint32).astype(np.int64)
    table = np.frombuffer(parts[2][: 8 * n], np.uint32).reshape(n, 2)
    codes = np.frombuffer(parts[2][8 * n :], np.uint16)
    ids = decode_blocks(codes, table[:, 1].astype(np.int64), total, block, freq) if n else np.zeros(0, np.uint32)
    ends = np.cumsum(table[:, 1], dtype=np.int64)
    for i in range(n):
        if zlib.crc32(codes[ends[i] - table[i, 1] : ends[i]].tobytes(), zlib.crc32(ids[i * block : (i + 1) * block].tobytes())) != table[i, 0]:
            raise ValueError(f"block {i}: wrong checksum")
    if len(lengths) != docs or int(lengths.sum()) != total:
        raise ValueError("lengths of the documents don't fit")
    return ids, lengths


SHARDS = "first_doc long, part int, shard int, n_docs long, n_tokens long, doc_ids binary, data binary"


def _shards(batches, path: str, end_id: int):
    """Shards of a task's documents, which are in ascending order."""
    import zstandard
    from pyspark import TaskContext

    lib, part = tokenizer(path), TaskContext.get().partitionId()
    no, docs, lengths, held = 0, [], [], []

    def done(docs, lengths, ids):
        names = docs.fill_null(-1).to_numpy().astype(np.int64)
        nulls = docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        packed = zstandard.ZstdCompressor(level=3).compress(names.tobytes() + nulls.tobytes())
        first = docs.drop_null()
        row = {"first_doc": first[0].as_py() if len(first) else None, "part": part, "shard": no, "n_docs": len(docs), "n_tokens": len(ids), "doc_ids": packed, "data": write_shard(ids, lengths)}
        return pa.RecordBatch.from_pylist([row], _schema())

    for batch in batches:
        for a, b in steps(batch.column(1)):
            ids, n = lib.batch(batch.column(1).slice(a, b - a))
            at = np.cumsum(n)
            docs.append(batch.column(0).slice(a, b - a)), lengths.append(n + 1), held.append(np.insert(ids, at, np.uint32(end_id)))
            if sum(map(len, held)) < SHARD_IDS:
                continue
            docs, lengths, held = pa.concat_arrays(docs), np.concatenate(lengths), np.concatenate(held)
            end, a, at = np.cumsum(lengths), 0, 0
            while len(held) - at >= SHARD_IDS:  # a shard ends with the document that fills it
                b = int(np.searchsorted(end, at + SHARD_IDS)) + 1
                yield done(docs.slice(a, b - a), lengths[a:b], held[at : end[b - 1]])
                no, a, at = no + 1, b, int(end[b - 1])
            docs, lengths, held = ([docs.slice(a)], [lengths[a:]], [held[at:].copy()]) if a < len(lengths) else ([], [], [])
    if docs:
        yield done(pa.concat_arrays(docs), np.concatenate(lengths), np.concatenate(held))


def _schema():
    return pa.schema([("first_doc", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("data", pa.binary())])


def write_tokens(docs: DataFrame, path: str, to: str, end_id: int = END_ID) -> None:
    """Writes the shards of all documents to the folder `to`, in ascending doc_id order, null first and equal ones by text."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # many rows of one id must not meet in one task: a hash of the text spreads them, and orders them
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    ordered.transform(in_arrow, lambda it: _shards(it, path, end_id), SHARDS).write.parquet(to)


def _documents(batches):
    """Of each document: its shard, its place, length and CRC-32, from decoded shards."""
    import zstandard

    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(5)), strict=True):  # one shard at a time
            base, names, data = (x.as_py() for x in row[2:])
            ids, lengths = read_shard(data)
            raw = zstandard.ZstdDecompressor().decompress(names)
            doc = np.frombuffer(raw[: 8 * len(lengths)], np.int64)
            null = np.frombuffer(raw[8 * len(lengths) :], np.uint8).astype(bool)
            starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
            view = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null), pa.array(starts[:-1] + base), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the shards in the folder `at`.

    The starts of shards are sums over the shards before; tasks and shards are numbered in the order of documents.
    """
    from pyspark.sql import Window

    shards = spark.read.schema(SHARDS).parquet(at)
    sizes = shards.select("part", "shard", "n_tokens")
    of_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each task that wrote
    before = of_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(F.broadcast(before), "part").select("part", "shard", (F.col("inner") + F.col("before")).alias("base"))
    joined = shards.select("part", "shard", "doc_ids", "data").join(F.broadcast(bases), ["part", "shard"])
    return joined.select("part", "shard", "base", "doc_ids", "data").transform(in_arrow, _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, to: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all documents as token shards and reads the files back: doc_id, start, n_tokens, ids_crc32 of each row.

    A null or empty text has only the end id; null ids come first, rows of one id are ordered by a hash of their texts,
    and those of the same text are alike. An empty table writes no shard and gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    to = to or scratch(spark, "token-shards")
    write_tokens(docs, path, to, end_id)
    return read_tokens(spark, to)
