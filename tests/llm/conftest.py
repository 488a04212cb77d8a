import pytest

WORDS = "ra mi to ke su la vo ni pe da zo hi".split()


def prose(n, seed):
    """n made-up words, the same for a seed."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty and blank texts, exact and near copies, shared lines and passages, repeated rows, one very long text."""
    base = prose(200, 1).split()
    edited = base.copy()
    edited[100] = "changed"
    passage = prose(70, 2)
    line = "a line that many documents hold"
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(edited)), (4, None), (5, ""), (6, "   \n\t "), (7, f"{prose(60, 3)} {passage} {prose(60, 4)}"),
        (8, f"{prose(40, 5)} {passage} {prose(90, 6)}"), (9, f"{line}\n{prose(30, 7)}\n{line}"), (10, f" {line.upper()} \nshort\n{prose(30, 8)}"), (11, "short\nshort"),
        (12, prose(40_000, 9)), (13, "x"), (13, "x"), (14, prose(120, 10) + ".\n" + prose(50, 11) + "!  two  spaces \n\n end "), (None, prose(55, 12)), (None, None), (-5, "negative key, émigré 12 o'clock don't"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With more columns, some of them named like those that operators make."""
    more = [(i, t, "en", "src0", len(t or ""), "keep") for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def tokenizer_json():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def pytest_configure(config):
    config.prose = prose
