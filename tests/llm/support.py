"""Odd tables that every operator must take, and small helpers."""

from __future__ import annotations

import random

import pyarrow as pa

SYLLABLES = ["ba", "co", "di", "fe", "gu", "ha", "ji", "ko", "lu", "me", "ni", "po", "ra", "se", "ti", "vo"]


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n)]


def documents(spark, rows, extra: bool = False):
    """rows of (doc_id, text[, lang, source]); ``extra`` adds columns whose names operators use inside."""
    rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
    columns = {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string()),
        "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())}
    if extra:
        for name in ("key", "fp", "size", "row", "at", "before", "n_words", "__key", "block", "score", "words", "doc", "draw"):
            columns[name] = pa.array([1] * len(rows), pa.int32())
    return spark.createDataFrame(pa.table(columns))


def items(spark, rows):
    return spark.createDataFrame(pa.table({
        "item_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))


def labels(spark, rows):
    return spark.createDataFrame(pa.table({
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int32()),
        "toxic": pa.array([r[2] for r in rows], pa.int32())}))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Null and empty texts, null ids, blanks only, repeated rows, one id with two texts, a very long text."""
    rng = random.Random(seed)
    text = " ".join(prose(rng, 80))
    long = " ".join(prose(rng, 30_000))
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b ", None, None), (None, text, "en", "b"), (None, None, None, None),
        (4, text, "en", "b"), (4, text, "en", "b"), (5, text, "fr", None), (6, "one two", "fr", "a"), (6, "three", "fr", "a"),
        (7, long, "en", "b"), (8, "... !!! ???", "en", "c"), (9, "Ünïcödé 漢字 текст", "de", "c"), (10, "a\n\n\nb  c\r\n d", "de", "c"),
    ]


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
