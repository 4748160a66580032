import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, score double, _cls string"


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, empty, null, tiny and very long
    texts; ids that repeat or are null."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(40)]
    passage = words(rng, 60)
    out = list(enumerate(base))
    out += [(100 + i, base[i % 5]) for i in range(12)]                                  # copies
    for i in range(12):                                                                 # near copies
        w = base[10 + i % 3].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, words(rng, 30) + " " + passage + " " + words(rng, 25)) for i in range(8)]
    out += [(400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "One two THREE"), (405, "one two three"),
            (406, "é" * 150 + " ünïcode " * 40), (407, "é" * 150 + " ünïcode " * 40), (408, "x" * 5000),
            (409, words(rng, 20_000)), (410, "ab" * 3000), (None, base[7]), (7, base[7]), (500, "tie tie tie tie")]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), 1, 2, 0.5, "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
