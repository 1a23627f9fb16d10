import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(6000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strong potions beneath a crimson moon tonight"
TEXTS = [
    (1, PASSAGE + " and then some words of its own follow here"),
    (2, "Other words come first. " + PASSAGE.upper()),
    (3, "Something new before it: " + PASSAGE + " and after."),
    (4, ""),
    (5, None),
    (6, " \t\n "),
    (7, "one"),
    (8, "one two"),
    (9, LONG),
    (10, LONG + " tail"),
    (11, "same text twice " * 8),
    (12, "same text twice " * 8),
    (13, "écrit à bob.smith@mail.example.com ou +1 (310) 555-4510, carte 4111 1111 1111 1111, hôte 10.0.0.255"),
    (14, "a\nb\na\n\nb\n # $ x % x x x x x x x"),
    (15, "日本語 ▁ text <|endoftext|> with  double  spaces "),
    (None, PASSAGE),
    (12, "same text twice " * 8),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those that operators make."""
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, "x", 4, 5.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, key int, w string, fp long, score double")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where(F.lit(False))


@pytest.fixture(scope="session")
def pairs():
    return list(TEXTS)
