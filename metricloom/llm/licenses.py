"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Templates fall into classes by their number of word shingles: class c has more than c / 2 and at most
c. A text is cut into windows of 2c shingles, one every c, so whatever c shingles long stands whole in
some window. Of a window that holds the wanted part of a template, a known least share of shingles is
shared, which sets the number of bands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import segments as S

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6
FILTER_BITS = 1 << 20
BROADCAST_BYTES = 32 << 20

# fixed values: license notices, as they are commonly written
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0 notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("All rights reserved", "All rights reserved."),
)


def least_overlap(size: int, contained: float = CONTAINED) -> float:
    """The smallest Jaccard similarity of a class's template and a window that holds enough of it."""
    shares = []
    for n in range(size // 2 + 1, size + 1):
        held = math.ceil(contained * n)
        shares.append(held / (2 * size + n - held))
    return min(shares)


def bands(size: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands of one MinHash each with which a window that holds enough of a template is missed at most so often."""
    return math.ceil(math.log(miss) / math.log(1 - least_overlap(size, contained)))


def _salts(n: int) -> np.ndarray:
    return np.random.default_rng(S.SEED + 1).integers(1, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def _class(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(n)))


def _shingles(text: str, shingle: int) -> tuple[int, list[str], np.ndarray]:
    """Words in a shingle (fewer if the text has fewer), the distinct shingles and their hashes."""
    found = S.words(pa.array([text]), S.PUNCTUATION)
    n = len(found.starts)
    size = min(shingle, n)
    if not n:
        return 0, [], np.zeros(0, np.uint64)
    values, _ = S.grams(found.hashes(), found.row, size)
    texts = [found.text(i, i + size) for i in range(n - size + 1)]
    return size, list(dict.fromkeys(texts)), np.array(list(dict(zip(texts, values, strict=True)).values()), np.uint64)


def _literal(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A table made on the driver; broadcast if its bytes, known here, are few."""
    table = pa.Table.from_pylist(rows, schema=schema)
    frame = spark.createDataFrame(table)
    return F.broadcast(frame) if table.nbytes <= BROADCAST_BYTES else frame


def _index(spark: SparkSession, templates, shingle: int) -> tuple[DataFrame, DataFrame, dict[tuple[int, int], np.ndarray]]:
    """One row for each template and band, each template's shingles, and the shingle hashes of each (words, class)."""
    rows, lists, known = [], [], {}
    for name, text in templates:
        words, texts, hashes = _shingles(text, shingle)
        if not texts:
            continue
        size = _class(len(texts))
        known.setdefault((words, size), []).append(hashes)
        number = len(lists)
        lists.append({"template": number, "license": name, "shingles": texts})
        for band, salt in enumerate(_salts(bands(size))):
            least = int(S.mixed(hashes * salt).min().view(np.int64))
            rows.append({"template": number, "words": words, "size": size, "band": band, "value": least})
    bands_of = _literal(spark, rows, pa.schema([
        ("template", pa.int32()), ("words", pa.int32()), ("size", pa.int32()), ("band", pa.int32()), ("value", pa.int64())]))
    shingles_of = _literal(spark, lists, pa.schema([
        ("template", pa.int32()), ("license", pa.string()), ("shingles", pa.list_(pa.string()))]))
    return bands_of, shingles_of, {k: np.unique(np.concatenate(v)) for k, v in known.items()}


def windows(docs: DataFrame, known: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(doc_id, key, words, size, start, values, text) of windows that share a shingle with a template.

    A window's MinHash can equal a template's only if the window holds the template's shingle of that
    hash, so windows without any are left out: a bitmap of fixed size finds shingles that may be one.
    """
    maps = {}
    for kind, hashes in known.items():
        maps[kind] = np.zeros(FILTER_BITS, bool)
        maps[kind][hashes % np.uint64(FILTER_BITS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in S.slices(batch.column(2)):
                found = S.words(batch.column(2).slice(low, high - low), S.PUNCTUATION)
                hashes, made = found.hashes(), []
                for (words, size), bits in maps.items():
                    values, whole = S.grams(hashes, found.row, words)
                    hit = np.flatnonzero(whole)
                    hit = hit[bits[values[hit] % np.uint64(FILTER_BITS)]]
                    # windows begin at multiples of size; a shingle stands in the one at or before it, and in the one before that
                    block = (hit - found.first[found.row[hit]]) // size
                    places = {(r, b) for r, x in zip(found.row[hit].tolist(), block.tolist(), strict=True) for b in (x - 1, x) if b >= 0}
                    salts = _salts(bands(size))
                    for row, b in sorted(places):
                        first, end = int(found.first[row]), int(found.first[row + 1])
                        start = first + b * size
                        stop = min(start + 2 * size, end - words + 1)
                        least = S.mixed(values[start:stop, None] * salts).min(axis=0)
                        made.append((low + row, words, size, start - first, least.view(np.int64), found.text(start, stop + words - 1)))
                if made:
                    rows, *rest = zip(*made, strict=True)
                    at = pa.array(rows, pa.int64())
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(list(x), k) for x, k in zip(rest, kinds, strict=True)]],
                        ["doc_id", "key", "words", "size", "start", "values", "text"])

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("bigint"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), text).mapInArrow(
        run, "doc_id bigint, key bigint, words int, size int, start bigint, values array<bigint>, text string")


def licenses(docs: DataFrame, templates=TEMPLATES, shingle: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, key, license, containment, first_word, n_windows) for every text and license found in it.

    ``templates`` is a list of (name, text); several may have one name. Words are runs of
    ASCII letters and digits and of other characters, A-Z lower-cased; a template of fewer words than
    a shingle is one shingle. A license is found where a window holds at least ``contained`` of its
    template's distinct shingles; ``containment`` is the largest share, ``first_word`` the start of the
    first window that has it, ``n_windows`` counts the windows that have enough.

    A null or empty text has no license; rows of one doc_id and text give one row, key being a hash of
    the text; null doc_ids are kept apart by it too. Texts without a license, templates without a word
    and empty tables give no rows. Other columns are ignored.
    """
    bands_of, shingles_of, known = _index(docs.sparkSession, templates, shingle)
    banded = windows(docs, known).select("*", F.posexplode("values").alias("band", "value")).drop("values")
    met = banded.join(bands_of, ["words", "size", "band", "value"]).groupBy(
        "doc_id", "key", "template", "words", "start").agg(F.min("text").alias("text")).join(shingles_of, "template")
    parts = F.split("text", " ")
    own = F.transform(
        F.sequence(F.lit(1), F.size(parts) - F.col("words") + 1), lambda i: F.array_join(F.slice(F.col("parts"), i, F.col("words")), " "))
    shared = F.size(F.array_intersect("shingles", own)) / F.size("shingles")
    verified = met.withColumn("parts", parts).withColumn("containment", shared).where(F.col("containment") >= contained)
    best = F.min(F.struct((-F.col("containment")).alias("less"), F.col("start").alias("start")))
    return verified.groupBy("doc_id", "key", "license").agg(best.alias("best"), F.count("*").alias("n_windows")).select(
        "doc_id", "key", "license", (-F.col("best.less")).alias("containment"),
        F.col("best.start").alias("first_word"), "n_windows")
