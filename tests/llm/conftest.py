import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body int, tkey int, _row string, bitmap string"
WORDS = ("the", "of", "and", "tone", "pitch", "contour", "syllable", "vowel", "river", "stone", "light", "paper", "green", "market")


def prose(rng, n):
    """Words of which no two runs are alike."""
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(n))


def corpus():
    """Nulls, empty and long texts, copies, shared passages and lines, repeated rows, other scripts."""
    rng = random.Random(5)
    shared, line = prose(rng, 70), "Shared Line with the   words "
    texts = [None, "", "   \n\t ", "one", "two words", "\n\n\n", "x" * 3000, "ä é ß 漢字     end", "a\tb\x0bc\rd\ne  f"]
    texts += [prose(rng, rng.randrange(3, 90)) for _ in range(14)]
    texts += [prose(rng, 20) + " " + shared + " " + prose(rng, 15) for _ in range(4)]
    texts += [prose(rng, 40) + "\n" + line + "\n" + prose(rng, 5) + "\n" + line.upper() for _ in range(11)]
    texts += [texts[-1], texts[-1] + " more", texts[12], texts[12]]
    texts += [" ".join([prose(rng, 12) + "\n"] * 9), prose(rng, 4000)]
    rows = [(i * 3 % 101, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t), "x", i, None, "y", None) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, texts[11], "en", None, 1, None, None, None, None, None), (None, texts[13], None, None, 1, None, None, None, None, None), (rows[15][0], texts[16] + " other", "en", "s", 3, "", 0, 0, "", "")]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
