"""Small document tables for the corpus operators."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made_docs(n: int = 60, seed: int = 1) -> list[tuple]:
    """Invented prose in two languages, with copies, near copies and shared lines."""
    draw = random.Random(seed)
    words = {"en": ["the", "of", "stone", "river", "and", "walks", "greening", "a", "thinly", "over", "hand", "with", "bread", "is"],
             "de": ["der", "und", "fluss", "stein", "mit", "geht", "grün", "ein", "über", "hand", "brot", "ist", "für", "äpfel"]}
    out = []
    for k in range(n):
        lang = draw.choice(["en", "de"])
        lines = [" ".join(draw.choice(words[lang]) + (str(draw.randrange(9)) if draw.random() < 0.03 else "") for _ in range(draw.randint(4, 25)))
                 for _ in range(draw.randint(1, 8))]
        out.append((k, "\n".join(lines), lang, f"s{k % 3}", None))
    for k in range(n, n + 12):
        base = out[draw.randrange(n)]
        text = base[1].split(" ")
        if k % 2:
            text[draw.randrange(len(text))] = "altered"
        out.append((k, " ".join(text), base[2], "copy", None))
    return out


ODD = [
    (1000, None, "en", "x", None), (1001, "", "en", None, None), (1002, " \t\n ", None, "x", 3), (1003, "one", "en", "x", None),
    (1004, "one", "en", "x", None), (1004, "one", "en", "x", None), (1005, "a b c d e f\n" * 400, "de", "x", None), (1006, "é ñ ß\x0b\x85   ü", None, None, None),
    (1007, "w" * 30_000 + " end", "en", "x", None), (1008, "\n\n\nx\n", "", "x", None),
]

CLASHING = ["key", "hash", "word", "n", "group", "block", "kept", "words", "at", "seed", "row", "gone_lines", "own_id", "n_lines", "found", "language", "rep", "band"]


def frame(spark, rows, clash: bool = False):
    """The rows as a table; with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    out = spark.createDataFrame(rows, DOCS)
    return out.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clash else out


def ascii_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
