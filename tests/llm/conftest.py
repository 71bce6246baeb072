import pytest

from invented import prose

@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long and odd texts, with repeats."""
    return [None, "", " ", "\n\n", "one", "a b", "a b c", "Ünï cödé x  y\t z\r\n", "x" * 50_000, prose(1, 30_000), "tab\tsep  two  blanks ", "<|endoftext|> it's 3.14", "it's", "it's", "\x1c a \x01 b", "日本語 テキスト ▁ ok"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with columns that clash with the operators' own names."""
    rows = [(i, t, "n", 1.5, False, "row") for i, t in enumerate(odd_texts)] + [(3, "\n\n", "n", 0.5, True, "row"), (None, "no id", "n", 0.5, True, "row")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double, kept boolean, row string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
