"""The operators against brute force on small corpora."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row

from corpusloom.llm import decontamination, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, text_stats, token_counts, token_file, toxicity
from corpusloom.llm.bytewords import Splitter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall(text or "")


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# -- words -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lower", [False, True])
def test_words_from_bytes(rows, lower):
    import pyarrow as pa

    texts = [r[1] for r in rows] + ["tail", "", "head"]
    found, known = [], {}
    for w in Splitter(lower)(pa.array(texts).slice(1)):
        raw = w.raw.tobytes()
        for d in range(w.rows):
            at = range(w.begin[d], w.begin[d + 1])
            found.append([raw[w.start[i] : w.end[i]].decode() for i in at])
            for i, x in zip(at, found[-1], strict=True):
                assert known.setdefault(x, (w.hashes[0][i], w.hashes[1][i])) == (w.hashes[0][i], w.hashes[1][i])
    assert found == [[x.translate(LOWER) if lower else x for x in split(t)] for t in texts[1:]]
    assert len(set(known.values())) == len(known)


# -- 1 -----------------------------------------------------------------------------------------------------------------


def base(text):
    w = split(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules_base(odd):
    got = quality_rules.score_rules(odd)
    want = sorted(((r.doc_id, *base(r.text)) for r in odd.collect()), key=str)
    assert table(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_rules_empty(empty):
    assert quality_rules.score_rules(empty).count() == 0


def test_long_texts_count_alike():
    w = ("a b c d e f g " * 9000).split() + list(map(str, range(3000)))
    assert len(w) >= text_stats.LONG
    assert text_stats.repeated_words(w) == base(" ".join(w))[4]


def test_label_model_finds_the_bad():
    r = np.random.default_rng(1)
    bad = r.random(4000) < 0.15
    votes = np.where(bad[:, None], r.choice(3, (4000, 5), p=[0.5, 0.2, 0.3]), r.choice(3, (4000, 5), p=[0.02, 0.18, 0.8]))
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, table_ = quality_rules.fit(patterns, n.astype(float))
    got = quality_rules.posterior(votes, prior, table_) > 0.5
    assert abs(prior - 0.15) < 0.05 and (got == bad).mean() > 0.95


def test_junk_goes_and_clean_stays(spark):
    clean = [(i, " ".join(f"{a}{i}{j} of the it was" for j, a in enumerate(["wind", "river", "stone", "house", "green", "later"] * 3)), None) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{i}{j}###" for j in range(60)), None) for i in range(9)] + [(200 + i, " ".join(f"CAPS{i}{j}!!" for j in range(60)), None) for i in range(9)]
    got = {r.doc_id: r.kept for r in quality_rules.score_rules(spark.createDataFrame([*clean, *junk], "doc_id long, text string, quality string")).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


# -- 2 -----------------------------------------------------------------------------------------------------------------


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(text, items):
    w = bench_words(text)
    hit, found = set(), set()
    for name, item in items:
        v = bench_words(item)
        n = min(8, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("block", [10**6, 30])
def test_contamination(spark, odd, rows, block):
    texts = [r[1] for r in rows if r[1]]
    items = [(i, " ".join(bench_words(t)[i % 5 : i % 5 + 8 + i % 9])) for i, t in enumerate(texts[3:24])]
    items += [(90, None), (91, ""), (92, "--"), (93, "Ban"), (94, "two WORDS"), (94, "two words"), (95, items[4][1]), (96, "never met at all in any of these texts"), (97, "a b a b a b a b a b")]
    got = decontamination.find_contamination(odd, spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert table(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(((r.doc_id, *contamination(r.text, items)) for r in odd.collect()), key=str)


def test_contamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontamination.find_contamination(empty, none).count() == 0
    assert decontamination.drop_contaminated(docs, none).columns == docs.columns


def test_winnowing_keeps_one_of_every_span():
    h = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64)
    kept = set(decontamination.winnow(h, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(len(h) - 3))


# -- 3 -----------------------------------------------------------------------------------------------------------------


def without_repeats(rows, n=13):
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = split(t)
        gone = {i + j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(n)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("groups, salts", [(None, None), (7, 1), (7, 5)])
def test_repeats(odd, groups, salts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 50)  # so that hot minimisers occur
    last = 2**63 - 1
    want = without_repeats([(last if r.doc_id is None else r.doc_id, r.text) for r in odd.collect()])
    got = substring_dedup.digest(substring_dedup.remove_repeats(odd, groups=groups, salts=salts)).fillna({"doc_id": last})
    assert table(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_repeats_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_hot_windows_are_compared_in_two_rounds():
    text = np.frombuffer(b"a b c d e", np.uint8)
    copies = [substring_dedup.pack(np.array([d]), np.array([0]), np.array([2 * d], np.int32), np.array([2], np.int32), text) for d in range(40)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["group", "data"])
    dealt = sorted((7 + 3 * 4 + d % 4, x) for d, x in enumerate(copies))  # bucket group 3 of 7, in 4 parts
    first = pa.Table.from_batches(substring_dedup._verdicts([batch(dealt)], 7, 4, 4)).to_pylist()
    left = [(r["group"], r["data"]) for r in first if r["data"]]
    assert len(left) == 4 and {g for g, _ in left} == {3}  # a least copy of each part
    second = pa.Table.from_batches(substring_dedup._verdicts([batch(left)], 7, 4, 4)).to_pylist()
    assert all(r["data"] is None for r in second)
    gone = sorted((r["doc"], r["runs"]) for r in first + second if r["data"] is None)
    assert gone == [(d, [2 * d, 2 * d + 2]) for d in range(1, 40)]


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "rolled", lambda h, k, seed: np.zeros(max(0, len(h) - k + 1), np.uint64))
    a, b = b"a b c d e", b"a b x d e"
    part = [np.array(x) for x in ([1, 2, 3], [0, 0, 0], [0, 0, 0], [2, 2, 2])] + [np.frombuffer(b" ".join([a, b, a]), np.uint8)]
    doc, _, at = substring_dedup.repeated([part], 4)
    assert sorted(zip(doc.tolist(), at.tolist(), strict=True)) == [(3, 0), (3, 1)]


# -- 4 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def insults(spark):
    r = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = list(r.choice(plain, 40))
        for j in range(3 if toxic else 0):
            w[int(r.integers(40))] = ["jerkface", f"zugro{r.integers(90)}x", "Nitwit"][j]
        rows.append((i, " ".join(w), "x", None))
        if i % 10:
            labels.append((i, None if i % 50 == 7 else int(toxic), 1))
    rows += [(900, None, "x", None), (901, "", "x", None), (902, "jerkface nitwit", "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, row string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity(insults):
    docs, labels = insults
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == 603
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    assert sum(got[i].predicted != (i % 6 == 0) for i in range(600)) <= 3 and not any(got[i].predicted for i in range(600) if i % 6)
    assert got[902].predicted == 1 and got[900].score == got[901].score < 0.1


def test_toxicity_never_learns_from_held_out_labels(insults):
    from pyspark.sql import functions as F

    docs, labels = insults
    out = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert table(toxicity.score_toxicity(docs, labels), "doc_id", "score") == table(toxicity.score_toxicity(docs, turned), "doc_id", "score")


def test_toxicity_without_labels(docs, empty, insults):
    none = insults[1].limit(0)
    assert toxicity.score_toxicity(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty, none).count() == 0


# -- 5 -----------------------------------------------------------------------------------------------------------------


def groups(rows, k=3, threshold=85):
    sets = defaultdict(list)
    for d, t in rows:
        w = split((t or "").translate(LOWER))
        sets[d].append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and t and 100 * len(s & t) >= threshold * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted(((d, len(s), top(d), top(d) == d) for d, ss in sets.items() for s in ss), key=str)


def test_near_duplicates(docs):
    assert table(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == groups([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_five_words(docs):
    assert table(near_dedup.near_duplicates(docs, 80, 5), "doc_id", "n_shingles", "component_id", "kept") == groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80)


def test_near_duplicates_in_a_chain(spark):
    """A group whose members are linked to their neighbours alone: hubs can't join it."""
    w = [f"w{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(w[4 * i : 4 * i + 100])) for i in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert table(got, "doc_id", "n_shingles", "component_id", "kept") == groups(rows)
    assert got.where("kept").count() == 1


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A bucket of more members than a group holds: blocks meet in pairs, so links across blocks are found."""
    monkeypatch.setattr(near_dedup, "GROUP", 4)
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        near = list(base)
        for _ in range(r.randint(0, 8)):
            near[r.randrange(len(near))] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(near)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert table(got, "doc_id", "n_shingles", "component_id", "kept") == groups(rows)


@pytest.mark.parametrize("few", [0, 10_000])
def test_links_of_a_block(monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.where(r.random(300) < r.uniform(0, 0.12), r.integers(0, 1 << 63, 300).astype(np.uint64), base)) for _ in range(70)]
    labels, sigs = np.arange(70) // 2, near_dedup.packed(near_dedup.minima(sets))
    want = {(i, j) for i in range(70) for j in range(i) if labels[i] != labels[j] and near_dedup.agree(sets[i], sets[j], 85)}
    got = near_dedup.linked(labels, sigs, sets, 85)

    def parts(edges):
        up = list(range(70))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, j in edges:
            up[top(i)] = top(j)
        least = {}
        for i in range(70):
            least.setdefault(top(i), i)
        return [least[top(i)] for i in range(70)]

    assert len(want) > 100 and parts(got) == parts(want)


def test_groups_over_batches():
    import pyarrow as pa

    rows = [(k, p, v) for k in range(5) for p in range(2) for v in range(k)]
    batches = [pa.RecordBatch.from_pylist([{"k": k, "p": p, "v": v} for k, p, v in rows[i : i + 3]]) for i in range(0, len(rows), 3)]
    got = [(key, [v for x in parts for v in x.column(2).to_pylist()]) for key, parts in near_dedup._groups(iter(batches), 2)]
    assert got == [((k, p), list(range(k))) for k in range(1, 5) for p in range(2)]


def test_near_duplicates_odd(odd, empty):
    got = near_dedup.near_duplicates(odd)
    assert got.count() == odd.count() and got.where("doc_id IS NULL AND (component_id IS NOT NULL OR kept)").count() == 0
    kept = near_dedup.drop_near_duplicates(odd, 85, 3)
    assert kept.columns == odd.columns and kept.count() == got.where("kept").select("doc_id").distinct().count()
    assert near_dedup.near_duplicates(empty).count() == 0


def test_estimate_is_close(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(0)
    for share in (0.2, 0.6, 0.9):
        x = r.integers(0, 1 << 63, 4000).astype(np.uint64)
        a, b = np.unique(x[:3000]), np.unique(np.concatenate([x[: int(3000 * share)], x[3000:]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = near_dedup.packed(near_dedup.minima([a, b])).view(np.int64).tolist()
        got = spark.createDataFrame([(sig[0], sig[1])], "a array<long>, b array<long>").select(near_dedup.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(got - true) < 0.17


# -- 6 -----------------------------------------------------------------------------------------------------------------


def without_runs(rows, n):
    lines = [(d, t, (t or "").split("\n")) for d, t in rows]
    first = {}
    order = sorted(range(len(lines)), key=lambda i: lines[i][0])
    for i in order:
        for k in range(len(lines[i][2]) - n + 1):
            first.setdefault(tuple(lines[i][2][k : k + n]), (i, k))
    out = []
    for i, (d, _, ls) in enumerate(lines):
        gone = {k + j for k in range(len(ls) - n + 1) if first[tuple(ls[k : k + n])] != (i, k) for j in range(n)}
        kept = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        out.append((d, len(ls), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_line_runs(docs, n):
    got = line_dedup.digest(line_dedup.remove_line_runs(docs, n))
    assert table(got, "doc_id", "n_lines", "n_removed", "kept_sha256") == without_runs([(r.doc_id, r.text) for r in docs.collect()], n)


def test_line_runs_odd(odd, empty):
    assert line_dedup.remove_line_runs(odd).count() == odd.count()
    assert line_dedup.remove_line_runs(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.later_copies(odd, 3)


def test_line_runs_of_one_line(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, "once"), (5, "once")]
    got = line_dedup.remove_line_runs(spark.createDataFrame(docs, "doc_id long, text string"))
    assert table(got, "doc_id", "n_lines", "n_removed", "kept_text") == [(1, 3, 0, docs[0][1]), (2, 3, 1, "c\nd"), (3, 1, 1, ""), (4, 1, 0, "once"), (5, 1, 1, "")]


def test_line_runs_of_repeated_rows(spark):
    text = "\n".join(f"line {i}" for i in range(8))
    rows = [(1, text)] * 3 + [(None, text)] * 2 + [(2, "x\ny")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = line_dedup.later_copies(docs, 2).collect()
    assert {r["size"] for r in runs} == {2, 4, 8}
    assert len(runs) == 7 + 5 + 1
    assert sorted(r.n_removed for r in line_dedup.remove_line_runs(docs).collect()) == [0, 0, 0, 0, 0, 8, 8]


# -- 7 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    return lambda t: lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 40_000])
def test_shards_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.5, r.integers(0, 49408, n), np.tile(r.integers(0, 300, 50), n // 50 + 1)[:n]).astype(np.uint32)
    lengths = np.diff(np.concatenate([[0], np.sort(r.integers(0, n + 1, 6)), [n]]))
    got, sizes = token_file.read_shard(token_file.write_shard(ids, lengths))
    assert (got == ids).all() and (sizes == lengths).all()


@pytest.mark.parametrize("ids", [[0] * 3000, [7, 9] * 4000, [49407] * 10, list(range(20_000))])
def test_shards_of_extremes(ids):
    got, _ = token_file.read_shard(token_file.write_shard(np.array(ids, np.uint32), [len(ids)]))
    assert got.tolist() == ids


def test_shards_are_small_and_checked():
    ids = np.tile(np.arange(1000, 1100, dtype=np.uint32), 2000)
    data = token_file.write_shard(ids, [len(ids)])
    assert len(data) < 0.25 * ids.nbytes
    for at in (len(data) - 5, len(data) // 2):
        with pytest.raises(Exception):  # noqa: B017 - a wrong byte may break the layout or a checksum
            token_file.read_shard(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    with pytest.raises(ValueError):
        token_file.read_shard(b"nothing")


def test_token_file(docs, library):
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*library(r.text), 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert table(token_file.round_trip(docs, BPE), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_token_file_odd(odd, empty):
    got = token_file.round_trip(odd, BPE).collect()
    assert len(got) == odd.count()
    order = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(order, order[1:], strict=False))
    assert token_file.round_trip(empty, BPE).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([]) == {}
    assert mixing.targets([("a", 100)]) == {"a": 150.0}
    got = mixing.targets([("b", 10), ("a", 1000), (None, 500), ("c", 0)])
    assert got["b"] == 20 and got["c"] == 0 and list(got)[-1] is not None
    assert abs(sum(got.values()) - 1.5 * 1510) < 1e-6 and all(got[s] <= 2 * n for s, n in [("b", 10), ("a", 1000), (None, 500)])


def test_mixing(docs, rows):
    got = mixing.taken(docs).collect()
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    sums = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len(split(text[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        sums[source[r.doc_id]] += r.taken
    plan = mixing.targets([(s, sum(len(split(t)) for d, t in text.items() if source[d] == s)) for s in set(source.values())])
    for r in got:
        assert abs(r.target - plan[source[r.doc_id]]) < 1e-6
    for s, n in sums.items():
        assert abs(n - plan[s]) <= 0.02 * plan[s] + 60
    assert table(mixing.taken(docs.repartition(7)), "doc_id", "taken") == table(mixing.taken(docs), "doc_id", "taken")


def test_mixing_odd(odd, empty):
    assert mixing.taken(odd).count() == odd.count()
    assert mixing.taken(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_mixing_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 8)  # slots are as long as in a large corpus
    sizes = [(f"big{i}", 40_000) for i in range(3)] + [(f"small{i:02}", 100 + 23 * i) for i in range(40)] + [(None, 1), ("none", 0)]
    per = 50
    docs, n = [], 0
    for s, words in sizes:
        for at in range(0, max(1, words), 1000 if words > 2000 else per):
            docs.append((n, "w " * min(1000 if words > 2000 else per, words - at), s))
            n += 1
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got, source = mixing.taken(docs).collect(), {r.doc_id: r.source for r in docs.collect()}
    plan = mixing.targets(sizes)
    assert sum(plan.values()) / mixing.LEAST_SLOTS > mixing.BLOCK and len(got) == n
    sums = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        sums[source[r.doc_id]] += r.taken
    assert all(abs(sums[s] - plan[s]) <= 1 for s, _ in sizes)


def mixed_by_hand(rows):
    """What the mix takes of each row (doc_id, source, size, h, tie), slot by slot and word by word."""
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
    plan = mixing.targets([(s, sum(r.size for r in rs)) for s, rs in sources.items()])
    names = sorted(s for s in plan if s is not None) + [None] * (None in plan)
    want = sum(plan.values())
    n_slots = round(want / max(1, min(mixing.BLOCK, int(want // mixing.LEAST_SLOTS))))
    bounds, slots, out = [sum(plan[s] / want for s in names[: i + 1]) for i in range(len(names) - 1)], Counter(), []
    for i in range(n_slots):
        slots[names[sum(b <= (i + 0.5) * mixing.GOLDEN % 1.0 for b in bounds)]] += 1
    for s, rs in sources.items():
        chunks = math.isqrt(len(rs))
        rs = sorted(rs, key=lambda r: ((r.h >> 20) % chunks, r.h, r.doc_id is not None, r.doc_id or 0, r.tie, r.size))  # noqa: B023
        words = [k for k, r in enumerate(rs) for _ in range(r.size)]
        goal, took, at = round(plan[s]), Counter(), 0
        for k in range(slots[s]):
            for _ in range(goal // slots[s] + (k < goal % slots[s])):
                took[words[at % len(words)]] += 1
                at += 1
        out += [(r.doc_id, r.size, len(words), plan[s], took[k]) for k, r in enumerate(rs)]
    return sorted(out, key=str)


def test_mixing_equals_a_walk_through_the_slots(docs):
    keyed = docs.selectExpr("doc_id", "source", "text", "xxhash64(doc_id, 17) AS h", "xxhash64(text) AS tie").collect()
    rows = [Row(doc_id=r.doc_id, source=r.source, size=len(split(r.text)), h=r.h, tie=r.tie) for r in keyed]
    assert table(mixing.taken(docs), "doc_id", "size", "source_size", "target", "taken") == mixed_by_hand(rows)


def test_schedule_has_low_discrepancy(spark):
    shares = [0.5, 0.8, 1.0]
    slots = mixing.schedule(spark, shares, 200_000).collect()
    for s, p in enumerate([0.5, 0.3, 0.2]):
        mine = sorted((r.slot, r.rank) for r in slots if r.source_no == s)
        assert [k for _, k in mine] == list(range(len(mine))) and abs(len(mine) - 200_000 * p) < 20


# -- 9 -----------------------------------------------------------------------------------------------------------------


def test_quality_classifier(spark):
    r = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 0
        w = [f"w{x}" for x in r.integers(0, 5000, 60)] + ["of", "the"] * 9
        rows.append((i, " ".join(x + "%%%" if bad else x for x in w), "host" if i % 3 else None, ["p", "q", None][i % 3], i))
        if i % 2:
            labels.append((i, None if i % 31 == 0 else int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, z int")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_classifier.score_quality(docs, labels).collect()}
    assert len(got) == 800 and all(got[i].kept == (i % 5 != 0) for i in range(800))
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(0 <= got[i].score <= 1 for i in held)
    assert quality_classifier.keep_quality(docs, labels).columns == docs.columns


def test_sparse_sites_are_shrunk(spark):
    """A host with a single document says next to nothing; one with many bad documents weighs on all of its own."""
    rows = [(i, "plain words of the text " * (8 + i % 5), "good", "a") for i in range(300)] + [(400 + i, "###$$$ " * 40, "bad", "a") for i in range(300)] + [(900, "plain words of the text " * 9, "new", "a")]
    labels = [(i, 1 if i < 300 else 0) for i in [*range(300), *range(400, 700)]]
    got = {x.doc_id: x for x in quality_classifier.score_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[400].host_rate < 0.1 < got[900].host_rate < got[0].host_rate


def test_quality_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.score_quality(odd, none).count() == odd.count()
    assert quality_classifier.score_quality(empty, none).count() == 0


# -- 10 ----------------------------------------------------------------------------------------------------------------

TRICKY = ["İstanbul É é ﬁ ², don't I'LL we'd", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "x\u0085y z w", "...a.,b,. 1.2,3 $5.00, ok., ́e é.", "ΣΑΣ. ΟΔΟΣ, ǅ", "日本語。テスト 한국어", "\x00\x1f\x7f a", "'s 't It'S.", "a\tb\r\nc"]


def test_counts(odd, library):
    got = token_counts.count_tokens(odd, BPE)
    assert table(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(((r.doc_id, len((r.text or "").encode()), n := len(library(r.text)), n > 2048) for r in odd.collect()), key=str)


@pytest.mark.parametrize("text", TRICKY)
def test_pieces_equal_the_library(text, library):
    lib = token_counts.WordTokenizer(BPE)
    for _ in range(2):
        assert np.frombuffer(lib.ids(text), np.uint32).tolist() == library(text)


@pytest.mark.parametrize("overlap", [4, 16, 64])
def test_huge_texts_are_spliced(rows, library, overlap):
    lib = token_counts.WordTokenizer(BPE)
    for text in (" ".join(TRICKY) * 20, "y" * 5000, "word " * 900, "ab" * 700 + " " + "cd" * 700 + " e" * 300, "".join(r[1] or "" for r in rows[:40])):
        at = token_counts.cuts(lib.encode, text, chunk=500, overlap=overlap)
        assert at[0] == 0 and at[-1] == len(text) and at == sorted(set(at))
        assert [i for a, b in zip(at, at[1:], strict=False) for i in lib.encode(text[a:b]).ids] == library(text)


def test_huge_rows(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "HUGE", 2000)
    monkeypatch.setattr(token_counts.cuts, "__defaults__", (600, 40))
    texts = ["a b c. " * 900, "z" * 4000, "a b c. " * 900, None, "short"]
    df = spark.createDataFrame([(i if i != 2 else 0, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert table(token_counts.count_tokens(df, BPE), "doc_id", "n_tokens") == sorted(((i if i != 2 else 0, len(library(t))) for i, t in enumerate(texts)), key=str)
