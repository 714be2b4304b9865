import random

import pytest

SYLLABLES = "an er the on re ing ti ou sch ü é ñ la de que st".split()
CLASHING = ["h", "cell", "key", "host", "path", "rule", "verdict", "rate", "hits", "spans", "fp", "bucket", "kept", "score", "n", "start", "words", "digest"]


def make_texts(seed: int, count: int) -> list[tuple[int, str | None]]:
    """Invented texts with exact copies, copies that differ a little, shared passages, empty and null ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 70))) for _ in range(4)]
    texts: list[str | None] = []
    for _ in range(count):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.35 and (old := rng.choice(texts)):
            words = old.split(" ")
            words[rng.randrange(len(words))] = word()
            texts.append(rng.choice([" ", "  ", "\n"]).join(words))
        elif kind < 0.4:
            texts.append(rng.choice([None, "", " \n", "a", " ".join(["same"] * 120)]))
        else:
            words = [word() for _ in range(rng.randint(1, 150))]
            if rng.random() < 0.5:
                words.insert(rng.randrange(len(words) + 1), rng.choice(passages))
            texts.append(" ".join(words).capitalize() + rng.choice([".", "", "!!"]))
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def texts():
    return make_texts(7, 120)


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a documents table, with columns named like those that the operators use inside."""

    def build(rows, key="doc_id"):
        extra = ", ".join(f"{c} string" for c in CLASHING)
        schema = f"{key} long, text string, lang string, source string, n_chars long, {extra}"
        data = [(i, t, ("en", "de", None)[(i or 0) % 3], "src0", len(t or ""), *["x"] * len(CLASHING)) for i, t in rows]
        return spark.createDataFrame(data, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def rows_of():
    return lambda df, *columns: {tuple(r) for r in df.select(*columns).collect()}
