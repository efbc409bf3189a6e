import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, row string, size long, dk long, uid string"
WORDS = "the of and lantern river copper engine quiet market garden signal winter paper ocean ladder violet thunder meadow cabin harvest orbit velvet mirror".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ly", "x7"]) for _ in range(n))


def texts():
    """Ordinary texts, exact and near copies, a shared passage, very short, very long, empty and null ones."""
    rng = random.Random(5)
    out = [prose(rng, rng.randint(30, 200)) for _ in range(30)]
    passage = prose(rng, 70)
    out += [prose(rng, 40) + " " + passage + "\n" + prose(rng, 30), prose(rng, 25) + "\n" + passage + " " + prose(rng, 60)]
    near = prose(rng, 150).split()
    out += [" ".join(near), " ".join([*near[:70], "changed", *near[71:]]), " ".join([*near[:20], "other", *near[21:]])]
    out += [out[3], out[3], out[4].upper(), "", None, "a", "  \n\t ", "12345 678", "aaaa" * 300, "aaaa" * 300, "é" * 150 + " ü", prose(rng, 4000), "one two three", "one two three"]
    return out


def rows():
    langs, sources = ["en", "de", None], ["web", "book", None, "code"]
    out = [(i, t, langs[i % 3], sources[i % 4], len(t or ""), "k", "r", 1, 2, "u") for i, t in enumerate(texts())]
    return [*out, out[7], out[7], (None, "a text without an id and some words", None, None, 1, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
