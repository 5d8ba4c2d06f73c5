"""Toxicity by weak supervision.

Voters are learned from labelled rows: words, beginnings and ends of words that are far more frequent in toxic texts
than in others, dealt to groups that vote toxic or abstain, and voters on how many of them a text has. A generative label
model with a hidden class estimates each voter's votes in either class by expectation-maximisation; the given label
is one more voter, so wrong labels are outvoted. Voters that agree beyond what the class explains share their weight:
each is divided by the sum of its correlations given the class. A linear classifier is trained on the posterior labels
and scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bound_batches, in_arrow, materialise

#: Labelled rows that are learned from at most: those with the smallest hashes of doc_id.
LABELLED = 20_000
#: Share of toxic texts, and number of them, that an entry of the lexicon must be in; its log odds.
LEAST_SHARE, LEAST_TEXTS, LEAST_ODDS = 0.008, 4, 2.8
#: Lengths of beginnings and ends that are entries too.
PARTS = (4, 5, 6, 7, 8)
#: How often a given label is taken to be right.
LABEL_RIGHT = 0.985
GROUPS = 6
ROUNDS = 40
PREDICT_FROM = 0.7
WORD = re.compile(r"[^\W\d_]+")
KINDS = ("word", "head", "tail")


def entries_of(word: str) -> list[str]:
    """What a lower-case word may match: itself, its beginnings and its ends, marked by kind."""
    n = len(word)
    return [f"word:{word}", *(f"head:{word[:k]}" for k in PARTS if k < n), *(f"tail:{word[-k:]}" for k in PARTS if k < n)]


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _contexts(batches):
    """(entry, context) of toxic texts: a context is the words on both sides, as a number."""
    for batch in batches:
        found = set()
        for text in batch.column(0).to_pylist():
            words = WORD.findall((text or "").lower())
            for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                at = zlib.crc32(f"{before} {after}".encode())
                found.update((e, at) for e in entries_of(w))
        names, places = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64())], ["entry", "context"])


def _texts_with(batches, known):
    """entry, and how many texts have it, for each batch."""
    for batch in batches:
        count = Counter()
        for text in batch.column(0).to_pylist():
            count.update({e for w in set(WORD.findall((text or "").lower())) for e in entries_of(w)} & known.value)
        yield pa.RecordBatch.from_arrays([pa.array([*count], pa.string()), pa.array([*count.values()], pa.int64())], ["entry", "n"])


def learn_lexicon(rows: DataFrame, n_toxic: int, n_other: int) -> dict[str, float]:
    """Entries with their log odds. rows: text, label, of a bounded sample.

    In toxic texts an entry counts once for each different context, so near copies of one text make nothing of its
    ordinary words.
    """
    spark = rows.sparkSession
    least = max(LEAST_TEXTS, int(LEAST_SHARE * n_toxic))
    of_toxic = rows.filter("label = 1").select("text").transform(in_arrow, _contexts, "entry string, context long").distinct()
    often = of_toxic.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    # no more contexts count than there are texts, as the odds compare shares of texts
    counts = {r.entry: min(r.n, n_toxic) for r in often.collect()}
    held = spark.sparkContext.broadcast(set(counts))
    other = rows.filter("label = 0").select("text").transform(in_arrow, lambda it: _texts_with(it, held), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    others = {r.entry: r.n for r in other.collect()}
    return choose(counts, others, n_toxic, n_other)


def choose(counts: dict[str, int], others: dict[str, int], n_toxic: int, n_other: int) -> dict[str, float]:
    """The entries that tell, with their log odds. A part of words is taken where no longer part of it tells nearly as much alone."""
    odds = {e: float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((others.get(e, 0) + 0.5) / (n_other + 1))) for e, a in counts.items()}
    good = {e for e in odds if odds[e] >= LEAST_ODDS}
    weight = {e: odds[e] * np.sqrt(counts[e]) for e in good}
    keep = set()
    for e in good:
        kind, body = e.split(":", 1)
        up = [f"head:{body[:k]}" for k in PARTS if k < len(body)] if kind != "tail" else []
        up += [f"tail:{body[-k:]}" for k in PARTS if k < len(body)] if kind != "head" else []
        # what a shorter part in the lexicon tells already is left to that
        if not any(u in good and weight[u] >= weight[e] for u in up):
            keep.add(e)
    return {e: odds[e] for e in sorted(keep, key=lambda e: (-weight[e], e))}


class Voters:
    """Votes and features of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.names = [f"{k}{g}" for k in KINDS for g in range(GROUPS)]
        self.slot = {e: KINDS.index(e[:4]) * GROUPS + zlib.crc32(e.encode()) % GROUPS for e in lexicon}
        self.memo: dict[str, tuple] = {}

    def match(self, word: str) -> tuple:
        found = self.memo.get(word)
        if found is None:
            found = tuple((self.slot[e], self.lexicon[e]) for e in entries_of(word) if e in self.slot)
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Hits of each group, words, matching words, different ones, and the largest and the summed best log odds."""
        words = WORD.findall(text.lower())
        match, memo = self.match, self.memo
        groups, hits, kinds, top, total = [0.0] * len(self.names), 0, set(), 0.0, 0.0
        for w in words:
            found = memo.get(w)
            if found is None:
                found = match(w)
            if found:
                hits += 1
                kinds.add(w)
                best = 0.0
                for slot, odds in found:
                    groups[slot] += 1
                    best = max(best, odds)
                top = max(top, best)
                total += best
        return [*groups, len(words), hits, len(kinds), top, total]


def votes(x: np.ndarray) -> np.ndarray:
    """1 toxic, 0 other, -1 abstain, of each voter: the groups, then the numbers of matches, their density, their odds."""
    groups, words, hits, kinds, top, total = x[:, :-5], *x[:, -5:].T
    density = hits / np.maximum(words, 1)
    pick = lambda yes, no: np.where(yes, 1, np.where(no, 0, -1))
    return np.concatenate([
        np.where(groups > 0, 1, -1),
        np.stack([pick(kinds >= 2, hits == 0), pick(density >= 0.004, hits == 0), pick(top >= 5, top < 3), pick(total >= 8, total < 4), pick(hits >= 3, hits == 0)], 1),
    ], 1).astype(int)


def inputs(x: np.ndarray) -> np.ndarray:
    """What the linear classifier sees, with a constant first."""
    groups, words, hits, kinds, top, total = x[:, :-5], *x[:, -5:].T
    density = hits / np.maximum(words, 1)
    rest = [np.ones(len(x)), np.log1p(hits), np.log1p(kinds), np.minimum(density, 0.05) * 20, top / 10, np.minimum(total, 40) / 10, hits > 0, kinds > 1, kinds > 2, top > 5, np.log1p(words) / 5]
    return np.concatenate([np.stack(rest, 1).astype(float), (groups > 0).astype(float)], 1)


def label_model(v: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """P(toxic | votes) of each row; the given labels are the last voter."""
    v = np.concatenate([v, labels[:, None]], 1)
    n, m = v.shape
    if n == 0:
        return np.zeros(0)
    prior = (labels.sum() + 1) / (n + 2)
    q = np.where(labels == 1, 0.9, 0.1)
    scale = np.ones(m)
    for step in range(ROUNDS):
        both = np.stack([1 - q, q])
        table = np.stack([both @ (v == k) for k in (-1, 0, 1)], 2).transpose(1, 0, 2) + 0.5  # voter, class, vote
        table /= table.sum(2, keepdims=True)
        prior = (q.sum() + 1) / (n + 2)
        if step >= 2 and step % 6 == 2:  # what voters have in common beyond the class, as correlation of their residuals
            hit = (v == 1).astype(float)
            left = hit - q[:, None] * table[:, 1, 2] - (1 - q[:, None]) * table[:, 0, 2]
            spread = np.sqrt((left**2).mean(0) + 1e-9)
            shared = np.abs(left.T @ left / n / spread[:, None] / spread[None])
            scale = 1 / np.maximum(1, np.where(shared > 0.1, shared, 0).sum(1))
        ratio = np.log(table[:, 1] / table[:, 0])  # voter, vote
        ratio[-1] = np.log(LABEL_RIGHT / (1 - LABEL_RIGHT)) * np.array([0, -1, 1])
        scale[-1] = 1.0
        z = np.log(prior / (1 - prior)) + sum(scale[j] * ratio[j][v[:, j] + 1] for j in range(m))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q


def train(x: np.ndarray, q: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    rate = (q.sum() + 0.5) / (len(q) + 1)
    w[0] = np.log(rate / (1 - rate))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-4
    for _ in range(40 if len(q) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (q - p) - penalty * w)
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(batches, lexicon):
    voters = Voters(lexicon.value)
    for batch in batches:
        rows = [voters.features(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["row", "x"])


def _scores(batches, lexicon, weights):
    voters, w = Voters(lexicon.value), np.array(weights)
    for batch in batches:
        x = np.array([voters.features(t or "") for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1)
        z = inputs(x) @ w if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, train_limit: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    docs: doc_id, text; labels: doc_id, toxic (1, 0, null: no label), of which rows with crc32(doc_id) mod 3 = 1 are never
    learned from. Null and empty texts have no words and get the score of a text without matches. Repeated rows are scored
    each, alike, and learned from once; of different labelled rows train_limit are learned from, those with the least hashes of doc_id. Without toxic labels nothing is learned and all scores are the smoothed rate.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sample = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id"), F.col("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_limit)
    )
    # an id may have many rows: of different labelled rows, too, no more are learned from than train_limit
    key = ["doc_id", "h", "label"]
    labelled = materialise(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(*key[::2], F.xxhash64("text").alias("h"), "text"), "toxicity-labelled")
    chosen = labelled.select(key).distinct().orderBy(F.xxhash64("doc_id"), *key).limit(train_limit)
    rows = materialise(labelled.join(F.broadcast(chosen), key).dropDuplicates(key).select("text", "label", "doc_id"), "toxicity-sample")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    dealt = rows.select("text", "label", "doc_id").repartition(32, "doc_id").select("text", "label")
    lexicon = learn_lexicon(dealt, counts.get(1, 0), counts.get(0, 0)) if counts.get(1) else {}
    held = spark.sparkContext.broadcast(lexicon)
    seen = rows.select(F.struct("doc_id", "label").alias("row"), "text")
    seen = seen.transform(in_arrow, lambda it: _features(it, held), f"row {seen.dtypes[0][1]}, x array<double>").orderBy("row.doc_id", "row.label", "x").collect()
    x = np.array([r.x for r in seen]).reshape(len(seen), len(KINDS) * GROUPS + 5)
    label = np.array([r.row.label for r in seen], int)
    weights = train(inputs(x), label_model(votes(x), label)).tolist()
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").transform(in_arrow, lambda it: _scores(it, held, weights), f"doc_id {kind}, score double")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
