import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, a very long text, repeated rows, and columns whose names clash."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", None, 0),
        (3, " \n\t ", "en", "s", 4),
        (4, "the cat and the dog " * 30_000, "en", "s", 600_000),
        (5, "mail a@b.co now", None, "s", 15),
        (5, "mail a@b.co now", None, "s", 15),
        (6, "x" * 50_000, "en", "s", 50_000),
        (7, "Zeile eins\nZeile eins\nnicht \U0001f600 ja", "de", "s", None),
        (8, "idiot and scum, you pathetic clown", "en", "s", 34),
        (9, "<|endoftext|> and <s> \u0000 é", "fr", "s", 20),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ", id long, n int, score double, kept boolean, list int, a long, b long, rate double, p int, y int, bins int, start long, _1 int, pii string, f string, v double, grade int"
    return spark.createDataFrame([(*r, *[None] * (extra.count(","))) for r in rows], cols + extra)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
