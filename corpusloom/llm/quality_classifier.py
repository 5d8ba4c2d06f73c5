"""Quality by hierarchical empirical Bayes: a document classifier, corrected by what its host and path are like.

The classifier is a logistic regression on counts over the text, fitted to labelled rows. Its probabilities are summed
for each host and each path of a host by grouped aggregation over all documents. A host's rate of good documents is
shrunk towards the global rate, a path's towards its host's, as much as the spread between sites says; a document's
evidence is then moved by the log odds of its path against the global ones. Sparse sites move nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import join_lookup, materialise, unique_column
from corpusloom.llm.text_stats import text_stats

#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of doc_id.
LABELLED = 20_000
KEEP_FROM = 0.5
RIDGE = 1.0
#: Steps of each rate that the classifier has a weight for.
EDGES = {
    "log_words": (2.3, 3.0, 4.0, 5.5, 7.5), "symbols": (0.005, 0.02, 0.05, 0.15), "repeats": (0.01, 0.05, 0.1, 0.2, 0.4),
    "lines": (0.02, 0.1, 0.3), "capitals": (0.05, 0.15, 0.3, 0.6), "marks": (0.01, 0.05, 0.15, 0.4),
    "short": (0.05, 0.12, 0.2, 0.3), "length": (3.0, 4.0, 6.0, 8.0, 11.0), "distinct": (0.2, 0.4, 0.6), "digits": (0.02, 0.1),
}


def rates() -> dict:
    """Rates of a text over the columns of text_stats."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    return {
        "log_words": F.log(c("n_words") + 1.0), "symbols": c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)), "repeats": c("n_repeat_words") / words,
        "lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), "capitals": c("n_caps_words") / words, "marks": c("n_marks") / words,
        "short": c("n_short_words") / words, "length": c("word_chars") / words, "distinct": c("n_distinct_words") / F.sqrt(words), "digits": c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
    }


def design(rows: np.ndarray) -> np.ndarray:
    """Steps of EDGES, with a constant first."""
    steps = [rows[:, j : j + 1] > np.array(e)[None] for j, e in enumerate(EDGES.values())]
    return np.concatenate([np.ones((len(rows), 1)), *steps], 1).astype(float)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic regression with a ridge, by Newton's method. Without both classes, the smoothed rate alone."""
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 1) / (len(y) + 2)
    w[0] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _spread(sites: DataFrame, mean, prior) -> float:
    """Strength of a beta prior, in documents: from how far the sites' rates vary beyond what their counts explain."""
    r = sites.filter(F.col("n") > 1).agg(
        F.sum(F.col("n") * F.pow(mean - prior, 2)).alias("between"), F.sum(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(prior * (1 - prior)).alias("noise")
    ).first()
    if not r.k or not r.n:
        return 1e6
    variance = max(0.0, (r.between - r.noise) / r.n)
    level = r.noise / r.k
    return float(np.clip(level / variance - 1, 1.0, 1e6)) if variance > 0 else 1e6


def _judged_by(host: str, path: str) -> list:
    """What a row's verdict hangs on: a hash of columns skips nulls, so their places are hashed too."""
    return [F.col("text"), F.col("text").isNull(), F.col(host), F.col(host).isNull(), F.col(path), F.col(path).isNull()]


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", train_limit: int = LABELLED) -> DataFrame:
    """doc_id, doc_score, host_rate, path_rate, score, kept of each row.

    docs: doc_id, text, the columns `host` and `path`; labels: doc_id, quality (1 good, 0 bad, null: no label; repeated
    or contradicting labels count as rows). score is the probability of a good document; kept: score >= KEEP_FROM.
    Null texts count as empty, null hosts and paths are sites of their own, repeated rows count each and are judged
    alike. Without labels of both classes all documents get the same evidence. An empty table gives an empty result.
    """
    return _scored(docs, labels, host, path, train_limit).drop("_h64")


def _scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", train_limit: int = LABELLED) -> DataFrame:
    """score_quality, with a hash of what the verdict hangs on."""
    # labels of one third of all ids are left out of the fit, for held-out measurement
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    sample = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
        .select("doc_id", F.col("quality").cast("double").alias("_good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_limit)
    )
    known_by = F.xxhash64(*_judged_by(host, path)).alias("_h64")
    stats = text_stats(docs.select("doc_id", F.col(host).alias("_host"), F.col(path).alias("_path"), known_by, "text"), "doc_id", "_host", "_path", "_h64")
    features = materialise(stats.select("doc_id", "_host", "_path", "_h64", *[v.alias(k) for k, v in rates().items()]), "quality-rates")
    names = list(EDGES)
    known = features.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_h64").limit(train_limit).select(*names, "_good").collect()
    rows = np.array([[float(r[k]) for k in names] for r in known]).reshape(-1, len(names))
    w = fit(design(rows), np.array([r["_good"] for r in known]))

    z, at = F.lit(float(w[0])), 1
    for k, edges in EDGES.items():
        for e in edges:
            z = z + F.when(F.col(k) > e, float(w[at])).otherwise(0.0)
            at += 1
    scored = features.select("doc_id", "_host", "_path", "_h64", z.alias("z"))
    sites = scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(F.round(1 / (1 + F.exp(-F.col("z"))), 9).cast("decimal(28,9)")).cast("double").alias("good"))
    sites = materialise(sites, "quality-sites")
    total = sites.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (total.good + 1) / (total.n + 2) if total.n else 0.5
    hosts = sites.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    strong = _spread(hosts, F.col("good") / F.col("n"), F.lit(rate))
    hosts = hosts.select("_host", ((F.col("good") + rate * strong) / (F.col("n") + strong)).alias("host_rate"))
    paths = sites.join(hosts, sites["_host"].eqNullSafe(hosts["_host"])).drop(hosts["_host"])
    strong = _spread(paths, F.col("good") / F.col("n"), F.col("host_rate"))
    paths = paths.withColumn("path_rate", (F.col("good") + F.col("host_rate") * strong) / (F.col("n") + strong))
    key = lambda df: df.withColumns({"_h": F.coalesce("_host", F.lit("")), "_p": F.coalesce("_path", F.lit("")), "_hn": F.col("_host").isNull(), "_pn": F.col("_path").isNull()}).drop("_host", "_path")
    found = join_lookup(key(scored), key(paths.select("_host", "_path", "host_rate", "path_rate")), ["_h", "_p", "_hn", "_pn"], "inner")
    odds = lambda p: F.log(p / (1 - p))
    score = 1 / (1 + F.exp(-(F.col("z") + odds(F.col("path_rate")) - float(np.log(rate / (1 - rate))))))
    out = found.select("doc_id", "_h64", F.round(1 / (1 + F.exp(-F.col("z"))), 9).alias("doc_score"), F.round("host_rate", 9).alias("host_rate"), F.round("path_rate", 9).alias("path_rate"), F.round(score, 9).alias("score"))
    return out.withColumn("kept", F.col("score") >= KEEP_FROM)


def keep_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", **options) -> DataFrame:
    """The rows of docs that score_quality keeps, with all their columns, each judged by its own text and sites.

    Rows with a null doc_id are kept or go like any others. Of rows with one doc_id, those go whose own text is rejected.
    Rows that repeat in all of doc_id, text, host and path stay or go together, as often as they come.
    """
    of_row = unique_column(docs, "_of_row")
    kept = _scored(docs, labels, host, path, **options).filter("kept").select(F.col("doc_id").alias("_kept"), F.col("_h64").alias("_kept_h64")).distinct()
    marked = docs.withColumn(of_row, F.xxhash64(*_judged_by(host, path)))
    return marked.join(kept, marked["doc_id"].eqNullSafe(kept["_kept"]) & (marked[of_row] == kept["_kept_h64"]), "left_semi").drop(of_row)
