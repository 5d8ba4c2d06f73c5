"""The pipeline's stages, each judged on its own input."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from test_operators import bench_words, groups, split

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Inputs and outputs of all stages over a small corpus with junk, copies and leaks."""
    r = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bakedilomunaporisute" for b in ("n", "rs", "st", "lm")]
    text = lambda n: " ".join(r.choice(words, n))
    items = [(i, text(20)) for i in range(6)]
    docs, labels = [], []
    for i in range(240):
        t = text(int(r.integers(30, 90)))
        if i % 6 == 1:
            t = " ".join(w + "###" for w in t.split())
        elif i % 6 == 2 and i > 6:
            t = docs[i - 6][1] if i % 4 else docs[i - 6][1] + " tail"
        elif i % 12 == 3:
            t += " " + items[i % 6][1]
        docs.append((i, t, "en", f"s{i % 3}" if i % 5 else None, len(t)))
        labels.append((i, int(i % 6 != 1), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    out, df = [], spark.read.parquet(f"{at}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, df, at)
        got.write.parquet(f"{at}/out{k}")
        got = spark.read.parquet(f"{at}/out{k}")
        out.append((df.collect(), got.collect(), got.columns))
        df = got
    return at, items, out


def test_columns(stages):
    assert [len(corpus_pipeline.STAGES)] == [5] and all(columns == COLUMNS for *_, columns in stages[2][:-1])


def test_quality_drops_junk_and_keeps_clean(stages):
    before, after, _ = stages[2][0]
    kept = {r.doc_id for r in after}
    assert not any(r.doc_id in kept for r in before if r.text and "###" in r.text)
    clean = [r.doc_id for r in before if r.text and "###" not in r.text]
    assert len(kept & set(clean)) >= 0.98 * len(clean)


def test_one_document_of_each_group(stages):
    before, after, _ = stages[2][1]
    want = {d for d, _, _, kept in groups([(r.doc_id, r.text) for r in before], 5, 80) if kept}
    assert sorted(r.doc_id for r in after) == sorted(want)
    assert {r.doc_id: r for r in after}.items() <= {r.doc_id: r for r in before}.items()


def test_leaks_go(stages):
    before, after, _ = stages[2][2]
    windows = {tuple(w[i : i + 8]) for _, t in stages[1] for w in [bench_words(t)] for i in range(len(w) - 7)}
    leaks = lambda t: any(tuple(w[i : i + 8]) in windows for w in [bench_words(t)] for i in range(len(w) - 7))
    assert any(leaks(r.text) for r in before)
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not leaks(r.text))


def test_mix_is_near_its_targets(stages):
    from corpusloom.llm import mixing

    before, after, _ = stages[2][3]
    size, got = Counter(), Counter()
    for r in before:
        size[r.source] += len(split(r.text))
    for r in after:
        got[r.source] += len(split(r.text))
    for s, want in mixing.targets(list(size.items())).items():
        assert abs(got[s] - want) <= 90
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_tokens_of_all_that_is_left(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after, _ = stages[2][4]
    want = Counter()
    for r in before:
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == want


def test_run_is_the_stages(spark, stages):
    found = corpus_pipeline.run(spark, stages[0]).collect()
    assert Counter(tuple(r) for r in found) == Counter(tuple(r) for r in stages[2][-1][1])


def test_null_and_repeated_ids_are_judged_by_their_texts(spark):
    from corpusloom.llm import near_dedup, quality_classifier

    r = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "bakedilomunaporisute" for b in ("n", "rs", "st", "lm")]
    clean = [" ".join(r.choice(words, 60)) for _ in range(300)]
    junk = [" ".join(w + "###" for w in t.split()) for t in clean]
    rows = [(i, junk[i] if i % 3 == 0 else clean[i], "en", "s", 0) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    odd = [(None, clean[250], "en", "s", 1), (None, junk[251], "en", "s", 1), (500, clean[252], None, None, 1), (500, junk[253], None, None, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(x.doc_id, x.text) for x in quality_classifier.keep_quality(docs, labels).collect()]
    assert sorted(kept, key=str) == sorted([(d, t) for d, t, *_ in rows + odd if "###" not in t], key=str)

    repeated = [(i, clean[i]) for i in range(20)] + [(100 + i, clean[i + k]) for i in range(20) for k in (0, 100, 100)] + [(200, ""), (200, clean[200]), (None, clean[201])]
    docs = spark.createDataFrame(repeated, "doc_id long, text string")
    want = [(i, clean[i]) for i in range(20)] + [(100 + i, clean[100 + i]) for i in range(20)] + [(200, clean[200])]
    for part in (docs, docs.repartition(5)):
        kept = [tuple(x) for x in near_dedup.drop_near_duplicates(part).collect()]
        assert sorted(kept) == sorted(want)


def test_later_stages_judge_rows_by_their_texts(spark):
    """Null ids, and ids that repeat with other texts, in decontamination and mixing."""
    from corpusloom.llm import decontamination, mixing

    passage = " ".join(f"leak{i}" for i in range(12))
    rows = [(None, f"a b c {passage}", "s"), (None, "a clean text without an id", "s"), (1, passage, "s"), (1, "clean words of the same id", None), (2, None, "s"), (3, "", None), (4, passage, "t"), (4, passage, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    kept = [tuple(r) for r in decontamination.drop_contaminated(docs, items, least_items=1).collect()]
    assert Counter(kept) == Counter(r for r in rows if "leak1 " not in (r[1] or ""))
    assert decontamination.drop_contaminated(docs, items.limit(0), least_items=1).count() == len(rows)
    mixed = Counter(tuple(r) for r in mixing.mix(docs).collect())
    assert set(mixed) <= {r for r in rows if r[1]} and (None, "a clean text without an id", "s") in mixed and max(mixed.values()) <= 4


def test_empty_tables_through_all_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
