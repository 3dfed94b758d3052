import pytest

WORDS = "the of and in to a is that it for on with as was at by an be this from or had not are but what all were".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names clash."""
    long = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 97) for i in range(30_000))
    rows = [(1, "The cat sat on the mat and the dog sat on the rug.", "en"), (1, "The cat sat on the mat and the dog sat on the rug.", "en"),
            (2, None, "en"), (3, "", None), (4, " \t\n ", "fr"), (5, long, "en"), (None, "A text without an id.", None), (None, None, None),
            (6, "the cat sat on the mat and the dog sat on the rug.", "en"), (7, "<|endoftext|> 12 !! ünïcödé 漢字 😀", None), (8, "word", "en")]
    return spark.createDataFrame([(*r, "src0", 1, "x", 0.5, "c", 7, "k") for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, piece double, _text string, c0 int, component_id string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, None, 0), (None, 1, 0), (5, 0, 0), (8, 1, None)], "doc_id bigint, quality int, toxic int")


def prose(rng, n, words=None):
    return " ".join(rng.choice(words or WORDS) + rng.choice(["", "er", "ing", "ly", "tion"]) for _ in range(n))
