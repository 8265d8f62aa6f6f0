"""Small tables with the odd rows that every operator must take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc bigint, gone bigint, key string, template string"


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(words))


def odd_documents(spark, seed: int = 5, plain: int = 12):
    """Texts of plain prose, and: null and empty, white space, one word, ties, repeated rows, a null key, a very long text, other scripts; columns whose names clash."""
    rng = random.Random(seed)
    base = prose(rng, 80)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(plain)]
    words = base.split()
    texts += [base, base, base.upper(), " ".join([*words[:40], "edited", *words[41:]]), " ".join(words[:78])]
    texts += [None, "", " \t\r\n\x0b\x0c", "one", "one two three four", "日本語 한국어 🙂 ñ é", prose(rng, 30_000), "\n\n", "a" * 5000]
    rows = [(i * 3, t, None if i % 4 == 0 else "en", "s", None, 1, 2, "k", None) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, base, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
