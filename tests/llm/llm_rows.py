"""Rows that operators must not stumble over."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, score double, key string, uid string, host string, features string, word string, row string, carried string, ids string"


def words(n, seed=0, size=400):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(size)]
    return [stock[min(int(rng.expovariate(0.02)), size - 1)] for _ in range(n)]


def rows(texts, first=0):
    """Rows whose extra columns have names that operators use inside."""
    return [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, len(t or ""), 7, "x", 1.5, "k", "u", "h", "f", "w", "r", "c", "i") for i, t in enumerate(texts, first)]


AWKWARD = [
    None,
    "",
    " \n\t ",
    "word",
    "two words",
    "Ünïcode tëxt ünd mehr   　wide ﻿ marks",
    " ".join(words(30_000, 1)),
    "x" * 50_000,
    "a\n" * 300,
    "same text here for a tie of equal rows " * 9,
    "same text here for a tie of equal rows " * 9,
    "<|endoftext|> token = 'abcdefgh1234' \x00\x1c control",
    " ".join(words(200, 2)),
    " ".join(words(200, 3)),
    "SHOUTING WORDS!! " * 60,
]
