import pytest

WORDS = "the of and a stone river moved under light over seven hills where old men sat by slow water singing for rain that never came back home again".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i * seed) % len(WORDS)] + ("." if i % 11 == 10 else "") for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, blank and long texts, repeated rows and ids, and columns whose names operators use."""
    rows = [
        (1, prose(1, 80), "en", "kept"), (1, prose(1, 80), "en", "kept"), (2, None, None, None), (3, "", "en", ""), (4, " \n\t\n ", None, "x"), (None, prose(2, 60), "en", "n"),
        (None, None, None, None), (5, "word " * 30_000, "en", "long"), (6, "x" * 50_000, "en", "one word"), (7, "naïve ☃ 中文\u0085   a\x1cb", "fr", "odd"), (1, "another text of id one", "en", "same id"),
        (8, prose(1, 80) + "\n" + prose(9, 30), "en", "n"), (9, "\n".join(prose(k, 12) for k in range(3000)), "en", "many lines"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumns({c: __import__("pyspark").sql.functions.lit("clash") for c in ("kept", "fp", "h", "idx", "length", "n_words", "html", "host", "Ids")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
