"""Edge rows shared by the tests of the operators."""

import random

CLASH = ["fp", "chunk", "id", "recipe", "n", "key", "kept", "u", "v", "_keep_id", "text_sha256", "word", "h", "url_key"]
SCHEMA = "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows and copies with other white space."""
    base = words(1, 400)
    rows = [
        (1, base, "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (5, words(2, 40_000), "en"),
        (6, base.replace(" ", "\n"), "en"), (7, base.replace(" ", "  "), "de"), (7, base.replace(" ", "  "), "de"),
        (8, base.upper(), "en"), (9, "x" * 200_000, "en"), (10, "one", "en"), (11, "é ñ 漢字 😀   ▁", "fr"),
        (12, base + " " + words(3, 30), "en"), (None, words(4, 50), "en"), (13, words(4, 50), None), (14, "...", "en"),
        (15, base + " tail", "en"), (16, " ".join(["same"] * 300), "en"),
    ]
    return [(*r, *["clash"] * len(CLASH)) for r in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
