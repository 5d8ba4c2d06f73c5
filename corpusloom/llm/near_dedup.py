"""Near-duplicate detection by b-bit MinHash.

Every document gets HASHES minima over its shingle set. Bands of ROWS full minima give candidates; of each minimum the
low BITS bits are kept and packed into longs, and bit counts over two packed signatures give the similarity, corrected
for the BITS-bit values that agree by chance. Candidates well below the threshold by that estimate go, the others are
confirmed on the full shingle sets.

Documents with equal sets are one node. In each band bucket all nodes are first compared with one hub, the node whose id has
the least hash, so that buckets of one cluster mostly share their hub. Buckets that this leaves in several components
are then compared in full, but for pairs within the bucket's largest component: the members' sets go to a task as one block, or
where they are many, as pairs of blocks, and all intersections of a block come from products of its incidence matrix. A task
returns a spanning forest of the links that it finds. So no link between components is lost, no pair is ever a row, and each
set is sent once a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bytewords import Splitter, mixed
from corpusloom.llm.common import BROADCAST_ROWS, bound_batches, in_arrow, join_hot, materialise, unique_column, worker_state

SHINGLE, THRESHOLD = 3, 85
HASHES, ROWS, BITS = 160, 5, 4
BANDS = HASHES // ROWS
#: Estimates of less than the threshold by so much are dropped: over five standard errors.
MARGIN = 0.16
#: Members and shingles of a group of a bucket that are compared in one task; of two blocks where a bucket has more.
GROUP, WEIGHT = 2048, 1 << 20
#: Columns of an incidence matrix, rows of a strip of estimates; up to so many pairs are confirmed one by one.
COLUMNS, STRIP, FEW = 2048, 128, 64
#: Shingles in a step, so that its arrays stay in the cache.
STEP = 1 << 17
_SEED = np.random.default_rng(20_240_229)
FACTORS = (_SEED.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
MASKS = _SEED.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-shingles of word hashes."""
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(out) + i])
    return out


def shingle_sets(column: pa.Array, k: int):
    """Sorted distinct hashes of each text's k-shingles, A-Z lower-cased; of fewer words, the hash of all; of none, none. In steps."""
    for w in worker_state("splitter_lower_near", lambda: Splitter(lower=True, hashes=1, step_bytes=1 << 19))(column):
        h, none = w.hashes[0], np.zeros(0, np.uint64)
        every = shingles(h, k) if len(h) >= k else none
        yield [
            none if a == b else np.unique(every[a : b - k + 1]) if b - a >= k else shingles(h[a:b], b - a)
            for a, b in zip(w.begin[:-1].tolist(), w.begin[1:].tolist(), strict=True)
        ]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """[set, hash] minima; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        upto, n = at, 0
        while upto < len(sets) and (n == 0 or n + len(sets[upto]) <= STEP):
            n += len(sets[upto])
            upto += 1
        x = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : upto - 1])])
        for j in range(HASHES):
            out[at:upto, j] = np.minimum.reduceat((x ^ MASKS[j]) * FACTORS[j], starts)
        at = upto
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """[set, hash] minima to [set, long] with BITS bits of each."""
    per = 64 // BITS
    bits = ((low >> np.uint32(7)) & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), -1, per)
    return (bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), BANDS)).copy()
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key


def _sketches(batches, shingle: int):
    for batch in batches:
        n, digests, sigs, keys = [], [], [], []
        for sets in shingle_sets(batch.column(1), shingle):
            n += map(len, sets)
            digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            low = minima([sets[i] for i in full])
            sig, key = packed(low).view(np.int64), band_keys(low).view(np.int64)
            where = dict(zip(full, range(len(full)), strict=True))
            sigs += [sig[where[i]] if i in where else [] for i in range(len(sets))]
            keys += [key[where[i]] if i in where else [] for i in range(len(sets))]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, longs), pa.array(keys, longs)], ["doc_id", "h", "n_shingles", "digest", "sig", "bands"])


def _sets(batches, shingle: int):
    for batch in batches:
        at = 0
        for step in shingle_sets(batch.column(1), shingle):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(step)), pa.array([s.tobytes() for s in step], pa.binary())], ["id", "set"])
            at += len(step)



def estimate(sig_a: Column, sig_b: Column) -> Column:
    """Similarity from packed signatures: the share of equal BITS-bit values, corrected for chance."""
    differ = F.lit(0)
    ones = int("1" * 16, 16)  # the lowest bit of each value
    for i in range(HASHES * BITS // 64):
        x = F.element_at(sig_a, i + 1).bitwiseXOR(F.element_at(sig_b, i + 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones))
        differ = differ + F.bit_count(x)
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def agree(sets_a: np.ndarray, sets_b: np.ndarray, threshold: int) -> bool:
    """Whether two sets of hashes, sorted and distinct, reach the threshold."""
    if 100 * min(len(sets_a), len(sets_b)) < threshold * max(len(sets_a), len(sets_b)):
        return False
    both = np.sort(np.concatenate([sets_a, sets_b]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= threshold * (len(both) - same)


def estimates(sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """[a, b] similarities from packed signatures [set, long], as `estimate` gives them."""
    ones = np.uint64(int("1" * 16, 16))
    differ = np.zeros((len(sig_a), len(sig_b)), np.int32)
    for i in range(sig_a.shape[1]):
        x = sig_a[:, i, None] ^ sig_b[None, :, i]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        x &= ones
        differ += np.bitwise_count(x)
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """[i, j] sizes of the intersections of all pairs of sets: the product of the incidence matrix with itself, COLUMNS at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[column] > 1  # what is in one set only is in no intersection
    row, column = row[shared], (np.cumsum(n > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int32)
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - k * COLUMNS] = 1
        out += (part @ part.T).astype(np.int32)
    return out


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) pairs that connect what a symmetric matrix of links connects."""
    left, out = np.ones(len(link), bool), []
    for root in np.flatnonzero(link.any(1)).tolist():
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(link[front].any(0) & left)
            left[front] = False
            out += [(root, x) for x in front.tolist()]
    return out


def linked(labels: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the links between members of different labels."""
    size = np.array([len(s) for s in sets])
    may = np.empty((len(sets), len(sets)), bool)
    for a in range(0, len(sets), STRIP):
        at = slice(a, a + STRIP)
        small, large = np.minimum(size[at, None], size), np.maximum(size[at, None], size)
        may[at] = (labels[at, None] != labels) & (100 * small >= threshold * large)
        if may[at].any():
            may[at] &= estimates(sigs[at], sigs) >= threshold / 100 - MARGIN
    some = np.flatnonzero(may.any(1))
    if not len(some):
        return []
    may = may[np.ix_(some, some)]
    if may.sum() <= 2 * FEW:
        link = np.zeros(may.shape, bool)
        for i, j in np.argwhere(np.triu(may)).tolist():
            link[i, j] = link[j, i] = agree(sets[some[i]], sets[some[j]], threshold)
    else:
        same = intersections([sets[i] for i in some.tolist()])
        link = may & (100 * same >= threshold * (size[some, None] + size[some] - same))
    return [(int(some[i]), int(some[j])) for i, j in forest(link)]


def binaries(column: pa.Array) -> list[np.ndarray]:
    """The values of a binary column without nulls as arrays of 64-bit numbers, not copied."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [data[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _groups(batches, keys: int):
    """Rows with equal values in the first columns, which are longs: (values, lists of the other columns' parts)."""
    held, rest = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(key[:, a].tolist())
            if rest and held != now:
                yield held, rest
                rest = []
            held = now
            rest.append(batch.slice(a, b - a))
    if rest:
        yield held, rest


def _pairs_batch(a, b):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_hub(batches, threshold: int):
    """(hub, id) of members that reach the threshold with a set of their hub. A group's rows of the hub come first."""
    for (hub, _), parts in _groups(batches, 2):
        own, found = [], []
        for part in parts:
            for member, s in zip(part.column(2).to_pylist(), binaries(part.column(3)), strict=True):
                if member == hub:
                    own.append(s)
                elif any(agree(s, x, threshold) for x in own):
                    found.append(member)
        yield _pairs_batch([hub] * len(found), found)


def _in_blocks(batches, threshold: int):
    """Pairs of components that a link connects, from groups of members: (key, part) and component, sig and set of each."""
    for _, parts in _groups(batches, 2):
        labels = np.concatenate([x.column(2).to_numpy() for x in parts])
        if (labels == labels[0]).all():
            continue
        sigs = np.concatenate([x.column(3).flatten().to_numpy().reshape(x.num_rows, -1) for x in parts]).view(np.uint64)
        found = linked(labels, sigs, [s for x in parts for s in binaries(x.column(4))], threshold)
        if found:
            yield _pairs_batch(labels[[i for i, _ in found]], labels[[j for _, j in found]])


def hub_links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (hub, id) whose sets reach the threshold, as (a, b). A hub's set is sent once to each GROUP of its members."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"), F.count("*").alias("n"))
    parts = materialise(parts, "near-hubs")
    dealt = join_hot(pairs, parts, "hub", "n", pairs.count()).select("hub", F.expr("pmod(xxhash64(id), parts)").alias("part"), "id")
    own = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.col("hub").alias("id"))
    rows = dealt.unionByName(own).join(sets, "id").select("hub", "part", "id", "set")
    grouped = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))
    return grouped.transform(in_arrow, lambda it: _with_hub(it, threshold), "a long, b long")


def open_links(member: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int, total: int) -> DataFrame:
    """Pairs (a, b) of components that links connect within a bucket, from (key, id, component, size) of its members.

    Buckets with the same members are compared once. A bucket of more than GROUP members or WEIGHT shingles is dealt into blocks, apart for its
    largest component and the rest; groups are all pairs of blocks but those of the largest component with itself.
    """
    tally = member.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"), *(F.sum(F.expr(f"xxhash64(id, {i}) div 4294967296")).alias(f"f{i}") for i in range(3)))
    top = (
        tally.groupBy("key").agg(F.max(F.struct("n", "size", "component")).alias("top"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("size").alias("size"), *(F.sum(f"f{i}").alias(f"f{i}") for i in range(3)))
        .filter("k > 1").groupBy("f0", "f1", "f2", "n", "size").agg(F.min(F.struct("key", "top")).alias("one"))
    )
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n * 2 / GROUP), F.ceil(size * 2 / WEIGHT)).cast("int")
    few = (F.col("n") <= GROUP) & (F.col("size") <= WEIGHT)
    plan = top.select(
        F.col("one.key").alias("key"), "n", F.col("one.top.component").alias("major"), few.alias("few"),
        blocks(F.col("one.top.n"), F.col("one.top.size")).alias("majors"), blocks(F.col("n") - F.col("one.top.n"), F.col("size") - F.col("one.top.size")).alias("minors"),
    )
    dealt = join_hot(member, materialise(plan, "near-open"), "key", "n", total)
    block = F.expr("cast(pmod(xxhash64(id), if(component = major, majors, minors)) as int)")
    parts = F.expr("""case when few then array(0L)
        when component = major then transform(sequence(0, minors - 1), i -> i * 1000000000L + minors + block)
        else concat(transform(filter(sequence(0, minors - 1), i -> i <> block), i -> least(i, block) * 1000000000L + greatest(i, block)),
                    transform(sequence(minors, minors + majors - 1), i -> block * 1000000000L + i)) end""")
    groups = dealt.withColumn("block", block).select("key", F.explode(parts).alias("part"), "id", "component")
    rows = groups.join(nodes.select("id", "sig"), "id").join(sets, "id").select("key", "part", "component", "sig", "set")
    grouped = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return grouped.transform(in_arrow, lambda it: _in_blocks(it, threshold), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in edges (a, b): the least id that is reachable. Labels spread, and jump to their labels' labels."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), "component")
        jump = spread.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        moved = materialise(spread.join(jump, "next").select("id", F.least("next", "jump").alias("next"), "component"), "near-labels")
        changed = moved.filter("next < component").limit(1).count()
        labels = moved.select("id", F.col("next").alias("component"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Documents are linked when 100 * common >= threshold * all distinct shingles. component_id is the least doc_id that is
    reachable. Null and empty texts have no shingles and are linked with nothing. Rows of one doc_id are one document,
    linked if any of its texts is. A null doc_id takes no part: its component is null, and it isn't kept. An empty
    table gives an empty result. doc_id is an integer; columns but doc_id and text are not read.
    """
    return _judged(docs, threshold, shingle).drop("h")


def _judged(docs: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """near_duplicates, with the hash of each row's text."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialise(texts.withColumn("h", F.xxhash64("text")).transform(in_arrow, lambda it: _sketches(it, shingle), "doc_id long, h long, n_shingles long, digest binary, sig array<long>, bands array<long>"), "near-sketches")
    total = sketches.count()
    real = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = materialise(real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")), "near-nodes")

    rows = nodes.select("id", "size", F.explode("bands").alias("key"))
    places = nodes.count() * BANDS
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("hub")).filter("n > 1")
    buckets = materialise(buckets.select("key", "n", F.col("hub.id").alias("hub")), "near-buckets")
    members = materialise(join_hot(rows, buckets, "key", "n", places).select("key", "id", "size", "hub"), "near-members")
    needed = members.select("id").distinct()
    few = needed.count() <= BROADCAST_ROWS
    picked = texts.join(F.broadcast(needed) if few else needed, texts["doc_id"] == needed["id"], "left_semi")
    sets = materialise(picked.transform(in_arrow, lambda it: _sets(it, shingle), "id long, set binary").filter("length(set) > 0").distinct(), "near-sets")

    sigs = nodes.select("id", "sig")
    pairs = materialise(members.filter("id <> hub").select("hub", "id").distinct(), "near-pairs")
    per_hub = pairs.groupBy("hub").agg(F.count("*").alias("n")).join(sigs.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    near = join_hot(pairs, materialise(per_hub, "near-hub-sigs"), "hub", "n", pairs.count()).join(sigs, "id")
    near = near.filter(estimate(F.col("hub_sig"), F.col("sig")) >= threshold / 100 - MARGIN).select("hub", "id").distinct()
    labels = components(hub_links(materialise(near, "near-likely"), sets, threshold))

    # links that the hubs have left out
    member = members.join(labels, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
    member = materialise(member, "near-members")
    more = materialise(open_links(member, nodes, sets, threshold, places), "near-links")
    if more.limit(1).count():
        joined = components(more).select(F.col("id").alias("component"), F.col("component").alias("joined"))
        known = member.select("id", "component").distinct()
        labels = materialise(known.join(joined, "component", "left").select("id", F.coalesce("joined", "component").alias("component")), "near-labels")

    named = nodes.select("digest", "id", "n").join(labels, "id", "left").select("digest", "n", F.coalesce("component", "id").alias("component_id"))
    inside = join_hot(real.select("doc_id", "h", "n_shingles", "digest"), named, "digest", "n", total)
    alone = sketches.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).withColumn("component_id", F.col("doc_id"))
    out = inside.select("doc_id", "h", "n_shingles", "component_id").unionByName(alone.select("doc_id", "h", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, threshold: int = 80, shingle: int = 5) -> DataFrame:
    """One document of each component, with all columns: that of the least doc_id.

    Rows of one doc_id give one row. Where their texts differ, it is one whose own text is kept, not a duplicate of another
    document's: a text with shingles before one without, then the least hash. Rows without doc_id go.
    """
    h = unique_column(docs, "_h64")
    best = F.min(F.struct(F.col("n_shingles") == 0, "h")).alias("best")
    kept = _judged(docs, threshold, shingle).filter("kept").groupBy("doc_id").agg(best).select(F.col("doc_id").alias("_kept"), F.col("best.h").alias("_kept_h64"))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    found = hashed.join(kept, (hashed["doc_id"] == kept["_kept"]) & (hashed[h] == kept["_kept_h64"]), "left_semi").drop(h)
    return found.dropDuplicates(["doc_id"])
