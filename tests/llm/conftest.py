import pytest

from llm.prose import prose

from replyforge.llm.queries import import_here

@pytest.fixture(scope="session")
def llm(spark):
    """The session, with this package importable in Python workers."""
    import_here(spark)
    return spark


ODD_ROWS = [
    (None, "a text without an id, long enough to be a line", "x"),
    (1, None, None),
    (2, "", "x"),
    (3, "  \n\t\n ", "y"),
    (4, prose(4, 9000), "y"),
    (5, "the same row twice, long enough to be a line", "y"),
    (5, "the same row twice, long enough to be a line", "y"),
    (6, "\U0001d54f wide éß text </s> [INST] <|end|> \\ ok", "z"),
    (7, "word", None),
]


@pytest.fixture(scope="session")
def odd(llm):
    """NULLs, empty, blank and long texts, repeated rows, clashing column names."""
    rows = [(i, t, s, 1, 2, "k", 0.5, 9) for i, t, s in ODD_ROWS]
    return llm.createDataFrame(
        rows,
        "doc_id long, text string, source string, id long, n_lines int, key string, size double, "
        "n_dropped int",
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
