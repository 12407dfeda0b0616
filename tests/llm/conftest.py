"""Small tables with the cases every corpus operator must stand."""

import random

import pytest

LONG = "id long, body string"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits long, sequence_id string"


def sample_texts(n: int, seed: int = 3) -> list:
    """Random prose with copies, shared passages, odd characters, empty and null texts."""
    rnd = random.Random(seed)
    syllables = ["an", "the", "ti", "on", "er", "re", "sh", "blé", "öu", "ñd", "A", "Th"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    prose = lambda k: " ".join(word() + rnd.choice(["", "", "", ",", ".", ".\n"]) for _ in range(k))
    passage = prose(60)
    out = [prose(rnd.randint(1, 120)) for _ in range(n)]
    for i in range(0, n, 7):
        at = rnd.randint(0, len(out[i]))
        out[i] = out[i][:at] + " " + passage + " " + out[i][at:]
    for i in range(0, n, 9):
        out[i] = out[(i * 5 + 1) % n]
    for i in range(3, n, 11):
        words = out[(i * 3) % n].split()
        if len(words) > 30:
            words[rnd.randrange(len(words))] = "changed"
            out[i] = " ".join(words)
    out[0], out[1], out[2] = None, "", "   \n\t "
    out[4] = "Orre " * 900
    out[5] = "日本語 🙂 <|endoftext|> <s> \x00\x1c x́ İ ß ½ ▁▁ a  b"
    out[6] = "x" * 30_000
    return out


def documents(spark, texts, ids=None):
    """A documents table with further columns, some named like results."""
    rows = [(i, t, "en", "s", 1, 5, "no") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return sample_texts(90)


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents in no order, over several partitions, with a null id and a repeated row at the end."""
    rows = list(enumerate(texts)) + [(None, texts[10]), (20, texts[20])]
    random.Random(1).shuffle(rows)
    return documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
