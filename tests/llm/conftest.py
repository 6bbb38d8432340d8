import re

import pytest

DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n, size=40):
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)) if size else ""


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties,
    repeated rows."""
    base = prose(1, 300)
    rows = [
        (1, base, "en", "a"), (2, base, "en", None), (3, base + " one more", None, "b"), (4, None, "en", "a"),
        (5, "", "de", "a"), (6, " \n\t ", "de", "b"), (7, prose(2, 30_000), "fr", "a"), (8, "two words", "en", "a"),
        (8, "two words", "en", "a"), (None, prose(3, 100), "en", "a"), (9, "x" * 50_000, None, None),
        (10, "a\nthe very same line of text\nb\nthe very same line of text", "en", "a"),
        (11, "The very  same line of texT\nthe very same line if text\nend of it all, is it", "en", "a"),
        (12, prose(4, 80) + " " + " ".join(base.split()[100:180]) + " " + prose(5, 80), "es", "c"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t) if t else 0) for i, t, l, s in rows], DOC_COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_COLUMNS)


def clashing(docs):
    """More columns, with names that operators use themselves."""
    from pyspark.sql import functions as F
    return docs.select("*", *(F.lit(7).alias(c) for c in (
        "f", "n", "h", "pos", "seed", "ids", "score", "size", "b", "a", "n_removed", "_id", "_text", "_spans", "_removed", "_gone")))
