"""Brute-force versions and shared fixtures."""

import random
import re

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, **columns):
    rows = [(n, t, columns.get("lang", "en"), columns.get("source", "s"), len(t) if t is not None else None) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def some_words(rng: random.Random, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))
