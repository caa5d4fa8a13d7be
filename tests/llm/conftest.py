import random

import pytest

from graphloom.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")


def sentence(rng: random.Random, lang: str, n: int) -> str:
    parts = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ung ei ich ver keit be ß ü ä".split(), "fr": "é eau oi que ment tion la è ou ç".split()}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def make_docs(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "de", "fr"])
        out.append((i, " ".join(sentence(rng, lang, rng.randint(3, 12)) for _ in range(rng.randint(1, 12))), lang, "s", 0))
    return out


#: Null and empty texts, white space, marks only, repeats, a very long text, null ids and a null language.
ODD = [
    (1000, None, "en", "s", 0),
    (1001, "", "en", "s", 0),
    (1002, " \n\t ", "en", None, None),
    (1003, "... 123 !!", "en", "s", 0),
    (1004, "same words here", "en", "s", 0),
    (1004, "same words here", "en", "s", 0),
    (1005, "Same  WORDS\nhere", None, "s", 0),
    (None, "same words here", "en", "s", 0),
    (None, None, None, None, None),
    (1006, "x" * 70_000, "en", "s", 0),
    (1007, "long words repeat " * 3_000, "en", "s", 0),
    (1008, "<|endoftext|> é日本    İ 😀\r\n\r\n  two  blanks \n", "en", "s", 0),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(make_docs(40) + ODD, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
