import pytest

#: Documents with nulls, empty and long texts, repeats and ties.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the very large bear in the deep green forest today.\nSecond line here.\nThird line."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "Short."),
    (None, "No id has this text, which is long enough to have some words in it, so that rules can look at it at length, all of it, here."),
    (6, "spam ham " * 300),
    (7, "The quick brown fox jumps over the lazy dog and runs away from the very large bear in the deep green forest today.\nSecond line here.\nThird line."),
    (7, "The quick brown fox jumps over the lazy dog and runs away from the very large bear in the deep green forest today.\nSecond line here.\nThird line."),
    (8, "Élan vital ça va être l'été déjà là-bas où naïve façade coûte cher; 日本語 テキスト <|endoftext|> don't WE'LL."),
    (9, " ".join(f"w{i % 977}x{i}" for i in range(30000))),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 5) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, n_words string, slot int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
