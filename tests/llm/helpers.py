"""Small fixtures for the operators' tests."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h int, spans string"


def frame(spark, rows):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, ["en", "de", None][n % 3], "s", len(t or ""), "x", 1, "y") for n, (i, t) in enumerate(rows)], SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgéü") for _ in range(rnd.randint(1, 6))) + rnd.choice(["", "", "", ".", ",", "\n"])
                    for _ in range(n)) if vocabulary else ""


EDGES = [(None, "no id here at all"), (90, None), (91, ""), (92, " \n\t "), (93, "x" * 50_000), (94, "same text " * 30), (94, "same text " * 30), (95, "!!! ??? ---")]


def contract_words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
