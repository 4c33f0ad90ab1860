"""Small fixtures that every operator has to survive."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, word string, id long"
PAGES = "page_id long, url string, html string, row long, record string"


def sentence(random_state: random.Random, words: int) -> str:
    return " ".join("".join(random_state.choice("aeioubcdfg") for _ in range(random_state.randint(2, 8))) for _ in range(words))


def documents(spark, texts):
    """Rows (doc_id, text) with more columns, whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None, 7, "k", "w", 9) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd_texts(seed: int = 1) -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    state = random.Random(seed)
    long_text = sentence(state, 20_000)
    base = sentence(state, 60) + "."
    return [
        (1, base),
        (2, base),
        (2, base),
        (None, base),
        (None, None),
        (3, None),
        (4, ""),
        (4, ""),
        (5, " \n\t\n "),
        (6, "one"),
        (7, "one"),
        (8, long_text),
        (9, long_text + " and an end"),
        (10, "x" * 50_000),
        (11, base.replace(".", " more.")),
        (12, sentence(state, 80) + ".\n" + sentence(state, 40) + ".\n" + base),
        (13, "Home | About | Contact\n" + sentence(state, 50) + "."),
        (14, "é ü ñ 漢字 \x00 \x01 <|endoftext|> \r\n end"),
    ]
