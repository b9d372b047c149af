import os

import pytest

EDGES = [(0, None), (1, ""), (2, "   \n"), (3, "a"), (4, "A  b"), (5, "a b c d"), (6, "word " * 30_000), (None, "no id here"), (7, "a b c d"), (7, "a b c d")]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame(
        [(i, t, "x", 1, "y", 2) for i, t in EDGES], "doc_id long, text string, size string, score int, lang_pred string, shard int"
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


@pytest.fixture(scope="session", autouse=True)
def quiet_tokenizers():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
