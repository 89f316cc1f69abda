import random

import pytest

WORDS = "ann ben the of and for with river stone cloud Ëtna mañana straße x1 y22 Zed".split()
KIND = "doc_id long, text string, lang string, source string, node string, key long, size string, `a.b` string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, nulls, empties and a long one."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    out = [*base, base[0], base[0].upper(), base[1] + "\n", None, "", "   ", "one two three", "one two three", prose(rng, 30_000)]
    for text in base[:20]:
        for share in (0.02, 0.04, 0.06):
            words = text.split()
            for k in range(max(1, int(share * len(words)))):
                words[rng.randrange(len(words))] = f"new{k}"
            out.append(" ".join(words))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with repeated rows and columns whose names clash with those that operators make."""
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, "n", i, "z", "dot") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], KIND).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
