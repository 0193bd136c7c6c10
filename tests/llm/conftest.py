import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with copies, near copies, repeated lines, ties, repeated rows, nulls, empty and long texts."""
    rng = random.Random(7)
    base = ["\n".join(words(rng, rng.randint(12, 40)) for _ in range(rng.randint(2, 6))) for _ in range(40)]
    texts = [*base]
    for t in base[:10]:  # near copies: one word of many is another
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [base[0], base[0], base[1].replace(" ", "  "), base[2].upper(), "", "", None, " \n ", "one two", "one two", words(rng, 6000), "\n".join([base[3].split("\n")[0]] * 3)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[0], "en", "src0", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def cluttered(corpus):
    """The corpus with columns named as those that operators make."""
    names = ["id", "key", "digest", "size", "shard", "slot", "score", "copies", "rate", "dropped", "a", "b", "component", "n", "line", "ids", "label", "toxic"]
    from pyspark.sql import functions as F

    return corpus.select("*", *(F.lit("x").alias(n) for n in names))
