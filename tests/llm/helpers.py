"""Small inputs with everything that documents can have."""

from __future__ import annotations

import random

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, words STRING, node BIGINT"

PROSE = (
    "the river runs past the old mill and the children who live there watch boats go by every "
    "morning before the bells of the church call them to their lessons in the long grey house"
).split()


def prose(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + rng.choice(["", "s", "ed", "ing", "ly"]) for _ in range(n))


def documents(spark, texts: list[tuple[int | None, str | None]], lang: str = "en"):
    """Documents with columns whose names operators use inside."""
    rows = [(i, t, lang, "src", len(t or ""), "w", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Null ids, null and empty texts, blanks, ties and repeated rows, a very long text."""
    long = " ".join(prose(s, 500) for s in range(40))
    return documents(
        spark,
        [
            (1, None), (2, ""), (3, " \t\n\x0b "), (None, "no id here"), (None, None), (4, "one"),
            (5, prose(1)), (5, prose(1)), (6, prose(1)), (7, long), (8, "é ß   日本語 🙂"),
        ],
    )


def empty(spark):
    return spark.createDataFrame([], DOCS)
