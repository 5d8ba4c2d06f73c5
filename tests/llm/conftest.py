import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, h string, part int"


def corpus(seed=5):
    """Small documents with what goes wrong: nulls, empty and long texts, copies, near copies, shared passages, clashing column names."""
    r = random.Random(seed)
    vocabulary = [a + b for a in "ba de ki lo mu na po ri su te wa xo".split() for b in "n r s t l m".split()] + ["über", "naïve", "ESSE", "don't"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = words(60), words(120)
    texts = [None, "", "   \n\t ", "one", "two words", "\n\n\n", " ".join(words(9000)), "a b " * 40, "x" * 3000]
    for i in range(50):
        body = words(r.randint(20, 200))
        if i % 4 == 0:
            at = r.randint(0, len(body))
            body[at:at] = passage
        texts.append("\n".join(" ".join(body[k : k + 11]) for k in range(0, len(body), 11)))
    for i in range(12):
        near = list(base)
        for _ in range(i % 4):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [texts[20], texts[20], texts[31], " ".join(base).upper(), " ".join(base) + "\u0085  x"]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(order[i], t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "row", i, None, None) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The same with a null doc_id, and with rows that repeat."""
    more = [(None, "null id here " * 9, *rows[9][2:]), (None, None, *rows[9][2:]), rows[10], rows[10], (rows[11][0], rows[12][1], *rows[11][2:])]
    return spark.createDataFrame([*rows, *more], SHAPE).repartition(3)
