import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"


def rows(seed=1, n=120):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 6))) for _ in range(300)] + ["Été", "naïve,", "日本", "x-y", "a.b"]
    texts = []
    for k in range(n):
        words = [random.choice(vocabulary) for _ in range(random.choice([1, 3, 12, 40, 90, 150]))]
        if texts and k % 4 == 0 and len(words) > 12:
            old = (random.choice(texts) or "").split()
            words[5:5] = old[3:60]
        text = ""
        for i, w in enumerate(words):
            text += (random.choice([" ", " ", " ", "\n", "  ", "\t"]) if i else "") + w
        if texts and k % 7 == 0:
            text = random.choice(texts)
        texts.append(text)
    texts += [None, None, "", "", "   ", "\n\n", "of " * 60, "of " * 45 + "end", "A line\nB\nC\nD\nA line\nB\nC\nE", "!!! " * 30, "w" * 3000]
    made = [(k, t, random.choice(["en", "de", None]), random.choice(["s0", "s0", "s1", None]), None, "clash", "clash") for k, t in enumerate(texts)]
    return [*made, made[3], made[3], (3, "same id, other text", "en", "s1", None, "c", "c"), (None, "no id", None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
