"""Inputs and plain reference versions for the operator tests."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = {"id": "x", "k": "y", "size": "z", "part": "p", "h": "q", "n": "r", "bucket": "s", "copies": "t", "row": "u"}
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def documents(spark, rows, clash=True):
    """rows of (doc_id, text[, lang, source]); with extra columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC)
    if clash:
        from pyspark.sql import functions as F

        for name, value in CLASH.items():
            df = df.withColumn(name, F.lit(value))
    return df


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
