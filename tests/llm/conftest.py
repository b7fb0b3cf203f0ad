import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token string, score double, `class` string, part int"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(["th", "er", "in", "on", "at", "re"], k=r.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    """Ordinary, null, empty, blank, very short, very long, equal and nearly equal texts."""
    base = prose(1, 60).split()
    near = [*base[:58], "other", "end"]
    out = {10: " ".join(base), 11: " ".join(near), 12: " ".join(base), 13: None, 14: "", 15: " \n\t ", 16: "one", 17: "one two three four", 18: prose(2, 20_000), 19: "ONE TWO three four", 20: "é中 ß <|endoftext|> x\x1cy  z don't THE'LL 12 ...", 21: "a" * 5_000}
    out |= {100 + i: prose(100 + i, 40 + i) for i in range(30)}
    out |= {200 + i: " ".join([*base[:57], f"u{i}", f"v{i}", f"w{i}"]) for i in range(5)}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with other columns whose names clash with the operators' own."""
    rows = [(k, v, None if k % 7 == 0 else "en", "s", len(v or ""), 1, "t", 0.5, "c", 3) for k, v in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark):
    """A row without an id, and the same row three times."""
    rows = [(None, "some text without an id at all", *[None] * 8)] + [(7, "the very same row again and again", *[None] * 8)] * 3
    return spark.createDataFrame(rows, SCHEMA)
