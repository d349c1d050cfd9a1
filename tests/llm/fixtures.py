"""Rows that every operator over documents must stand: nulls, empty and long texts, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, row string, out string, spans string, batch string, id long, node long, at string"


def awkward(spark, texts):
    """The texts as documents with columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"r{i}", "o", "s", None, i, None, "a") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def edge_texts():
    return [None, "", " \t\n", "one", "Two words", "ß é 漢字 😀", "x" * 30_000, "word " * 5_000, "a b c d e f g h i j k l", "a b c d e f g h i j k l", "A B C D E F G H I J K L", "\x00 nul\x00", "1 2 3"]


def fuzz(seed, alphabet, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(n)]
