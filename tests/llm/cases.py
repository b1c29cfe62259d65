"""Rows that every operator must take."""

import random

PARAGRAPH = "the slow river turns around the old mill while seven grey herons wait for small fish under the broken bridge and nobody counts the hours"


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(("alder", "birch", "cedar", "dune", "ember", "fjord", "glade", "heath", "inlet", "jetty", "knoll", "ledge", "marsh", "notch", "oxbow", "plain")) + rng.choice(("s", "ed", "ing", "", "ly")) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text, lang): nulls, empties, blanks, long texts, ties, repeated rows."""
    long = " ".join(prose(s, 400) for s in range(12))
    return [
        (1, PARAGRAPH, "en"),
        (2, PARAGRAPH, None),
        (2, PARAGRAPH, None),
        (3, "", "en"),
        (4, None, "en"),
        (None, "no identifier here at all", "en"),
        (None, PARAGRAPH, "en"),
        (5, " \t\n\r ", "en"),
        (6, long, "en"),
        (7, long + " tail", "de"),
        (8, "x" * 5000, "en"),
        (9, "ünï çödé 漢字 🙂 don't  á \xa0 <|endoftext|> 12345", "fr"),
        (10, "word " * 300, "en"),
        (11, "STOP!! NOW!! " * 40, "en"),
        (12, "one two", "en"),
        (13, "ONE two", "en"),
        (14, prose(1) + "\n" + prose(2) + "\n" + prose(1), "es"),
        (15, prose(1) + "\n" + prose(2) + "\n" + prose(3), "es"),
        (-5, "line\n\nline\n \nother", "en"),
    ]


SCHEMA = "doc_id bigint, text string, lang string"
