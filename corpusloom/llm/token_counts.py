"""Token counts by the tokenizer library, with overlap resynchronisation for huge documents.

A huge document is cut into chunks that overlap. Each chunk is encoded with offsets; two neighbours are
spliced at a place in their overlap where both encodings have a token boundary behind ASCII white space and
agree on all boundaries from there to the overlap's end, which the pre-tokenizer proves to be stable. Where
they don't, the overlap is widened and both chunks are encoded again, at last the whole document at once.

Chunks are themselves rows, so that one huge document is encoded by many tasks. Other texts are cut at ASCII
white space, where this pre-tokenizer always cuts, and pieces already met are not encoded again.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bound_batches, in_arrow, worker_state

#: Characters from which a document is huge, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 15, 1 << 9
#: Words that a worker remembers, about.
MEMORY = 250_000
#: Bytes of texts that are encoded at once.
STEP_BYTES = 8 << 20
LIMIT = 2048
SPACES = " \t\n\r"
#: Words that go to the library in one call.
WORDS = 20_000
#: ASCII characters that end a pre-token of letters and form one of their own: neither an apostrophe, which can begin a suffix, nor what begins a special token.
POINTS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(i) for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7))
#: Letters that NFC leaves alone, whatever is beside them, and whose case is a matter of the letter alone; with a tail of POINTS.
LATIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[!-&(-/:;=-@\[-`{-~]*$"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def spread(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + n[0]], flat[start[1] : start[1] + n[1]], ... one after the other."""
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((start - (end - n)).astype(kind), n) + np.arange(total, dtype=kind)]


class Known:
    """The ids of some strings. Beyond MEMORY strings, only those of the last call are kept."""

    def __init__(self):
        self.keys = pa.array([], pa.string())
        self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __call__(self, strings: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all of distinct strings, number of ids of each); learn(strings) gives ids and numbers of those not met before."""
        at = pc.index_in(strings, value_set=self.keys)
        new = pc.is_null(at)
        fresh = strings.filter(new)
        if len(fresh):
            ids, n = learn(fresh)
            where = at.fill_null(0).to_numpy().astype(np.int64)
            where[new.to_numpy(zero_copy_only=False)] = len(self.n) + np.arange(len(fresh))
            self.keys, self.n, self.flat = pa.concat_arrays([self.keys, fresh]), np.concatenate([self.n, n]), np.concatenate([self.flat, ids])
        else:
            where = at.to_numpy().astype(np.int64)
        n = self.n[where]
        flat = spread(self.flat, (np.cumsum(self.n) - self.n)[where], n)
        if len(self.keys) >= MEMORY:
            self.keys, self.n, self.flat = strings, n, flat
        return flat, n


class WordTokenizer:
    """word_bpe files: a tokenizer that drops white space and never joins what white space parts.

    The ids equal the library's encode(text, add_special_tokens=False). Texts are cut at ASCII white space, and each distinct piece of a
    batch is encoded once. A piece of Latin letters and a tail of points is two pre-tokens: its letters in lower case go straight to
    the library's merges, many words in one call, parted again by the ends of words that the vocabulary marks.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.lib = path, Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        letters = byte_letters()
        letters[32] = " "  # parts words here
        self.letters = np.array(list(map(ord, letters)), "<u4")
        self.words = Tokenizer(self.lib.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.cores, self.others = Known(), Known()

    def encode(self, text: str):
        return self.lib.encode(text, add_special_tokens=False)

    def _others(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.lib.encode_batch_fast(strings.to_pylist(), add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _cores(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of words in lower case."""
        out = []
        for i in range(0, len(strings), WORDS):
            part = strings.slice(i, WORDS)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            spelt = self.letters[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
            out.append(np.array(self.words.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(out)
        end = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(end, prepend=0)) if len(end) == len(strings) else self._others(strings)  # each word ends in one token that says so

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each). A null text has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary
        latin = pc.match_substring_regex(pieces, LATIN)
        whole, rest = pieces.filter(latin), pieces.filter(pc.invert(latin))
        cores = pc.utf8_lower(pc.utf8_rtrim(whole, POINTS)).dictionary_encode()
        tails = pc.utf8_ltrim(whole, LETTERS).dictionary_encode()
        core_ids, core_n = self.cores(cores.dictionary, self._cores)
        # the tails come first among the others; those of the rest that are a tail as well are met twice, which does no harm
        both = pa.concat_arrays([tails.dictionary, rest]).dictionary_encode()
        ids, n = self.others(both.dictionary, self._others)
        at, which = (np.cumsum(n) - n)[(index := both.indices.to_numpy())] + len(core_ids), n[index]
        # each piece is its core and its tail, or what the library makes of it, and nothing
        start, size = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        is_latin = latin.to_numpy(zero_copy_only=False)
        start[is_latin, 0], size[is_latin, 0] = (np.cumsum(core_n) - core_n)[(index := cores.indices.to_numpy())], core_n[index]
        start[is_latin, 1], size[is_latin, 1] = at[(index := tails.indices.to_numpy())], which[index]
        start[~is_latin, 0], size[~is_latin, 0] = at[len(tails.dictionary) :], which[len(tails.dictionary) :]
        flat = spread(np.concatenate([core_ids, ids]), start.ravel(), size.ravel())
        n = size.sum(1)
        index = coded.indices.to_numpy()
        n, start = n[index], (np.cumsum(n) - n)[index]
        offsets = lists.offsets.to_numpy()
        return spread(flat, start, n), np.diff(np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]])

    def ids(self, text: str) -> bytes:
        """The ids as little-endian uint32."""
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def count(self, text: str) -> int:
        return int(self.batch(pa.array([text], pa.string()))[1][0])


def tokenizer(path: str) -> WordTokenizer:
    return worker_state(f"tokenizer_{path}", lambda: WordTokenizer(path))


def steps(texts: pa.Array) -> list[tuple[int, int]]:
    """Bounds of slices of at most STEP_BYTES, or one longer text."""
    end = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))])
    out, a = [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(end, end[a] + STEP_BYTES, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def boundaries(encoding, base: int) -> list[tuple[int, int]]:
    return [(a + base, b + base) for a, b in encoding.offsets]


def splice(encode, text: str, start: int, end: int, overlap: int) -> int | None:
    """The place in [end - overlap, end) where the encodings of text[start:end] and of what follows can be joined.

    The place has white space before it and none at it, and both encodings have the same tokens from it to the last white
    space of the overlap: what is cut at either end of the overlap lies outside.
    """
    low, after = end - overlap, min(len(text), end + overlap)
    stop = next((i for i in range(end - 1, low, -1) if text[i] in SPACES), None)
    if stop is None:
        return None
    a = {t for t in boundaries(encode(text[start:end]), start) if t[0] >= low and t[1] <= stop}
    b = {t for t in boundaries(encode(text[low:after]), low) if t[1] <= stop}
    differ = max((t[1] for t in a ^ b), default=low)
    return next((x for x in range(max(low + 1, differ), stop) if text[x - 1] in SPACES and text[x] not in SPACES), None)


def cuts(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Places at which a huge text can be cut without changing its tokens: 0, ..., len(text)."""
    out, at = [0], 0
    while len(text) - at > chunk:
        end, wide, x = at + chunk, overlap, None
        while x is None and end < len(text):
            x = splice(encode, text, max(at, end - 2 * wide), end, min(wide, end - at - 1))
            if x is None:  # widen: twice the overlap, and a later end once it fills the chunk
                wide *= 2
                if wide >= end - at:
                    end = min(len(text), end + wide)
        if x is None:
            break
        out.append(x)
        at = x
    return [*out, len(text)] if len(text) > out[-1] else out


def _chunks(batches, path: str):
    """doc_id, part, text: huge texts in pieces that can be encoded alone, others as they are."""
    lib = tokenizer(path)
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1).to_pylist()
        ids, keys, parts, pieces = docs.to_pylist(), [], [], []
        for i, t in zip(ids, texts, strict=True):
            at = cuts(lib.encode, t)
            for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                keys.append(i), parts.append(k), pieces.append(t[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(keys, docs.type), pa.array(parts, pa.int32()), pa.array(pieces, pa.string())], ["row", "part", "text"])


def _spliced(batches, path: str):
    lib = tokenizer(path)
    for batch in batches:
        n = [len(lib.encode(t).ids) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["row", "n_tokens"])


def _counts(batches, path: str):
    lib = tokenizer(path)
    for batch in batches:
        texts = batch.column("text")
        size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        n = [lib.batch(texts.slice(a, b - a))[1] for a, b in steps(texts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    Null and empty texts have no tokens. Repeated rows are counted each. An empty table gives an empty result.
    Columns but doc_id and text are not read. Special strings inside a text are what the library makes of them.
    """
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")
    huge = F.length("text") >= HUGE
    small = rows.filter(~F.coalesce(huge, F.lit(False))).transform(in_arrow, lambda it: _counts(it, path), f"doc_id {kind}, n_bytes long, n_tokens long")
    key = F.struct("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n_bytes"))
    few = rows.filter(huge).select(key.alias("row"), "text")
    row = f"struct<doc_id:{kind},h:bigint,n_bytes:bigint>"
    pieces = few.transform(in_arrow, lambda it: _chunks(it, path), f"row {row}, part int, text string").repartition("row", "part")
    counted = pieces.select("row", "text").transform(in_arrow, lambda it: _spliced(it, path), f"row {row}, n_tokens long")
    # rows that repeat a huge document, text and all, have been cut into repeated pieces: their count says how often
    copies = rows.filter(huge).groupBy(key.alias("row")).agg(F.count("*").alias("n"))
    joined = counted.groupBy("row").agg(F.sum("n_tokens").alias("all_tokens")).join(copies, "row")
    large = joined.select("row.doc_id", "row.n_bytes", (F.col("all_tokens") / F.col("n")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")
    return small.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)
