"""Quality by weak supervision: rules vote good, bad or abstain, and a label model weighs them.

The label model has a hidden class for each document and, for each rule, the probabilities of its three votes in
either class. Expectation-maximisation needs no more than the number of documents with each pattern of votes, of
which there are at most 3 ** len(RULES); these are counted over all documents by one grouped aggregation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise
from corpusloom.llm.text_stats import text_stats

BAD, ABSTAIN, GOOD = 0, 1, 2
ROUNDS, KEEP_FROM = 60, 0.5
#: Votes bad, abstain, good that a rule is taken to give in the bad and the good class before any document is seen.
BELIEF = np.array([[0.35, 0.2, 0.45], [0.01, 0.14, 0.85]])
#: Documents that this belief counts for, as a share of all, and at least.
BELIEF_SHARE, BELIEF_LEAST = 0.02, 20.0
PRIOR_BAD = 0.1


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The votes, over the columns of text_stats. A text without words gets abstentions but for its length."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    symbols = c("n_symbols") / F.greatest(c("word_chars"), F.lit(1))
    length = c("word_chars") / words
    some = c("n_words") > 0
    return {
        "length": _rule(c("n_words") < 10, c("n_words") >= 30),
        "symbols": _rule(symbols > 0.1, some & (symbols < 0.02)),
        "repeats": _rule(c("n_repeat_words") > 0.2 * words, some & (c("n_repeat_words") < 0.05 * words)),
        "lines": _rule(c("n_dup_lines") > 0.3 * c("n_lines"), some & (c("n_dup_lines") == 0)),
        "capitals": _rule(c("n_caps_words") > 0.4 * words, some & (c("n_caps_words") < 0.1 * words)),
        "marks": _rule(c("n_marks") > 0.2 * words, some & (c("n_marks") < 0.03 * words)),
        "word_length": _rule(some & ((length < 2.5) | (length > 15)), some & length.between(3, 11)),
        "short_words": _rule((c("n_words") >= 20) & (c("n_short_words") < 0.04 * words), some & (c("n_short_words") > 0.12 * words)),
    }


def fit(patterns: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The probability of the bad class and P(vote | class) as [rule, class, vote], from patterns [k, rule] met n [k] times."""
    k, m = patterns.shape if patterns.size else (0, patterns.shape[1])
    weight = max(BELIEF_LEAST, BELIEF_SHARE * n.sum())
    bad = np.where((patterns == BAD).any(1), 0.9, 0.02) if k else np.zeros(0)
    prior, table = PRIOR_BAD, np.repeat(BELIEF[None], m, 0)
    for _ in range(ROUNDS):
        both = np.stack([bad * n, (1 - bad) * n])
        prior = (both[0].sum() + PRIOR_BAD * weight) / (n.sum() + weight)
        for v in range(3):
            table[:, :, v] = (both @ (patterns == v)).T + BELIEF[:, v] * weight * np.array([PRIOR_BAD, 1 - PRIOR_BAD])
        table /= table.sum(2, keepdims=True)
        bad = posterior(patterns, prior, table)
    return float(prior), table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(bad | votes)."""
    ratio = np.log(table[:, 0] / table[:, 1])
    z = np.log(prior / (1 - prior)) + sum((ratio[j][patterns[:, j]] for j in range(table.shape[0])), np.zeros(len(patterns)))
    return 1 / (1 + np.exp(-z))


def score_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality of each row.

    quality is the posterior probability of the good class under the label model; a row is kept if it passes the base
    rules and quality is KEEP_FROM at least. Null and empty texts have no words and fail the base rules. Repeated rows
    are judged each, alike. An empty table gives an empty result. Other columns are not read.
    """
    stats = materialise(text_stats(docs, "doc_id"), "rule-stats")
    votes = rules()
    voted = stats.withColumns({f"vote_{k}": v for k, v in votes.items()})
    names = [f"vote_{k}" for k in votes]
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    patterns = np.array([[r[x] for x in names] for r in rows], int).reshape(-1, len(names))
    prior, table = fit(patterns, np.array([r.n for r in rows], float))
    ratio = np.log(table[:, 0] / table[:, 1])
    z = F.lit(float(np.log(prior / (1 - prior))))
    for j, x in enumerate(names):
        z = z + F.element_at(F.array(*[F.lit(float(v)) for v in ratio[j]]), F.col(x) + 1)
    words = F.col("n_words")
    failed = (words < 10) | (100 * F.col("n_repeat_words") > 20 * words)
    quality = 1 - 1 / (1 + F.exp(-z))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (quality >= KEEP_FROM)).alias("kept"), F.round(quality, 9).alias("quality"),
    )
