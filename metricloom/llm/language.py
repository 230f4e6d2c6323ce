"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm import chargrams as C
from metricloom.llm import segments as S
from metricloom.session import stored

SIZES = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
# languages, of 2**BITS numbers each, that are counted in a task, gathered on the driver and broadcast at a time
LANGUAGES = 256
UNKNOWN = "und"


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def gram_counts(docs: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` (lang, text); bucket -1 counts the rows.

    A task adds up its own rows in arrays, for ``languages`` at a time: it passes on what it has before it
    begins with one more. Few languages make at most 2**BITS rows each of a task.
    """

    def sums(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < 1 << BITS, at, -1), pa.int32()), pa.array(own[at])],
                ["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            for number, lang in enumerate(coded.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(coded.indices, number))
                if lang not in totals and len(totals) >= languages:
                    yield from sums(totals)
                    totals.clear()
                own = totals.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                own[-1] += len(texts)
                for low, high in S.slices(texts):
                    for bucket, counts in C.grams(C.characters(texts.slice(low, high - low)), SIZES, BITS):
                        own[:-1] += np.bincount(bucket[counts], minlength=1 << BITS)
        yield from sums(totals)

    parts = docs.select(docs["lang"].cast("string"), docs["text"].cast("string")).mapInArrow(
        run, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, languages: int = LANGUAGES) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of ``languages`` languages by name with their log-probabilities; the last column is the log of the share of rows.

    Every row with text and lang that isn't held out is counted, and every language of them learned. A block is gathered
    when it is asked for, so the caller holds one at a time.
    """
    usable = docs.where(docs["text"].isNotNull() & docs["lang"].isNotNull() & docs["doc_id"].isNotNull()
                        & ~held_out(docs["doc_id"]))
    counts = stored(gram_counts(usable, languages), "language-counts")
    known = {r["lang"]: r["n"] for r in counts.where("bucket = -1").select("lang", "n").collect()}
    names = sorted(known)
    for first in range(0, len(names), languages):
        block = names[first:first + languages]
        wanted = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(block, pa.string())}))
        table = counts.join(F.broadcast(wanted), "lang").toArrow()
        matrix = np.zeros((len(block), (1 << BITS) + 1))
        row = np.searchsorted(np.array(block, object), table["lang"].to_numpy(zero_copy_only=False))
        matrix[row.astype(np.int64), table["bucket"].to_numpy()] = table["n"].to_numpy()
        rows = matrix[:, -1:].copy()
        grams = matrix[:, :-1] + SMOOTHING
        yield block, np.concatenate([
            np.log(grams / grams.sum(axis=1, keepdims=True)), np.log(np.maximum(rows, 1) / max(sum(known.values()), 1)),
        ], axis=1).astype(np.float32)


def posteriors(texts: pa.Array, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the best language of a block, its log-probability with the text, and the log of the block's sum."""
    best, top, whole = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    shares = block[:, -1:].astype(np.float64)
    for low, high in S.slices(texts, S.SLICE_BYTES // 2):
        chars = C.characters(texts.slice(low, high - low))
        sums = np.tile(shares, (1, len(chars)))
        for bucket, counts in C.grams(chars, SIZES, BITS):
            at = np.flatnonzero(counts)
            held = bucket[at]
            values = np.zeros(len(bucket))
            for lang, weights in enumerate(block):
                values[at] = weights[held]
                sums[lang] += C.row_sums(chars, values)
        best[low:high], top[low:high] = sums.argmax(axis=0), sums.max(axis=0)
        whole[low:high] = top[low:high] + np.log(np.exp(sums - top[low:high]).sum(axis=0))
    return best, top, whole


def predictions(docs: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text, lang).

    Rows with crc32(doc_id) mod 3 of 1 are never learned, nor are null texts, langs or doc_ids; only
    the text is scored. ``score`` is the posterior probability. A text that is null, empty or without a letter
    is ``und`` with score 0, as is every text if nothing can be learned. Equal posteriors go to the
    first language by name. Repeated rows are learned as often as they stand and score alike. Beyond ``languages`` languages
    every block of so many is a pass of its own over the texts, and one block, 32 MiB of 256, is in memory at a time. A text
    of any length is scored whole, with some 100 bytes a character in one task. Other columns are ignored.
    """
    text = docs["text"].cast("string")
    key = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
        key.alias("key"), text.alias("text"))
    parts: list[DataFrame] = []
    for names, block in learned(docs, languages):
        if parts:
            # with another block to come, what this one says is kept by text and its numbers are let go
            parts[-1] = _told(parts[-1])
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(_scored(rows, names, shared))
    if not parts:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(parts) == 1:
        scored = parts[0]
    else:
        parts[-1] = _told(parts[-1])
        told = reduce(DataFrame.unionByName, parts)
        highest = told.groupBy("key").agg(
            F.min(F.struct((-F.col("top")).alias("low"), "lang_pred")).alias("best"), F.max("whole").alias("most"))
        # sums of all blocks, scaled by the largest
        summed = told.join(highest, "key").groupBy("key", "best", "most").agg(F.sum(F.exp(F.col("whole") - F.col("most"))).alias("sum"))
        judged = summed.select(
            "key", F.col("best.lang_pred").alias("lang_pred"), (-F.col("best.low")).alias("top"),
            (F.col("most") + F.log("sum")).alias("whole"))
        scored = rows.select("doc_id", "has_letter", "key").join(judged, "key")
    return scored.select(
        "doc_id", F.when(F.col("has_letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("has_letter"), F.exp(F.col("top") - F.col("whole"))).otherwise(0.0).alias("score"))


def _scored(rows: DataFrame, names: list[str], shared) -> DataFrame:
    """(doc_id, has_letter, key, lang_pred, top, whole) of every row, by the languages of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, top, whole = posteriors(batch.column(3), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(names, pa.string()).take(pa.array(best)), pa.array(top), pa.array(whole)],
                ["doc_id", "has_letter", "key", "lang_pred", "top", "whole"])

    return rows.mapInArrow(run, "doc_id bigint, has_letter boolean, key binary, lang_pred string, top double, whole double")


def _told(part: DataFrame) -> DataFrame:
    """What a block says of each text, stored; copies of a text have one row."""
    return stored(part.select("key", "lang_pred", "top", "whole").dropDuplicates(["key"]), "language-block")
