"""Fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").lower())


def prose(rng: random.Random, n: int, size: int = 4000) -> list[str]:
    return [f"w{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n)]


def docs_frame(spark, rows, **extra):
    """rows: (doc_id, text) pairs."""
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return df
