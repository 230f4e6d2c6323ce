"""Quality selection by importance resampling.

Two bag-of-n-grams models over hashed tokens are counted, one of target text and one of all text. A
document's importance is the log-ratio of its probabilities under them; adding Gumbel noise and taking
the k largest draws k documents without replacement in proportion to their importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm import segments as S
from metricloom.operators.orderstats import Percentile, order_stats
from metricloom.session import stored

BITS = 16
SMOOTHING = 1.0
# the bound of the target sample
TARGET_ROWS = 20_000
KEPT_SHARE = 0.9


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens and token pairs, and their rows; a token is a run of word or of other characters."""
    parts = []
    data, offsets = S.raw(texts)
    word = S.words(texts, S.PUNCTUATION)
    # runs of punctuation are the other tokens: ASCII, neither blank nor letter nor digit
    other = S.words(texts, ~S.PUNCTUATION | S.BLANK)
    starts, ends = np.concatenate([word.starts, other.starts]), np.concatenate([word.ends, other.ends])
    order = np.argsort(starts, kind="stable")
    row = np.concatenate([word.row, other.row])[order]
    hashes = S.span_hashes(word.data, starts[order], ends[order])
    for k in (1, 2):
        values, whole = S.grams(hashes, row, k)
        parts.append(((values[whole] >> np.uint64(64 - BITS)).astype(np.int64), row[:len(values)][whole]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _models(docs: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the target rows and of all rows, in one pass; a task returns 2**BITS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for low, high in S.slices(batch.column(1)):
                buckets, row = _buckets(batch.column(1).slice(low, high - low))
                counts[0] += np.bincount(buckets, minlength=1 << BITS)
                counts[1] += np.bincount(buckets[wanted[low:high][row]], minlength=1 << BITS)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "all", "wanted"])

    marked = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).join(
        F.broadcast(target.withColumnRenamed("id", "doc_id").withColumn("wanted", F.lit(True))), "doc_id", "left")
    parts = marked.select(F.coalesce("wanted", F.lit(False)).alias("wanted"), "text").mapInArrow(
        run, "bucket int, all bigint, wanted bigint")
    table = parts.groupBy("bucket").agg(F.sum("all").alias("all"), F.sum("wanted").alias("wanted")).toArrow()
    out = np.zeros((2, 1 << BITS))
    out[0, table["bucket"].to_numpy()], out[1, table["bucket"].to_numpy()] = table["wanted"].to_numpy(), table["all"].to_numpy()
    return out[0], out[1]


def importance(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, seed: int = 11) -> DataFrame:
    """(doc_id, n_tokens, log_weight, draw) of every row; ``draw`` adds Gumbel noise from a hash of doc_id and text.

    The target is the text of up to ``target_rows`` documents labelled with quality 1, in the order of
    a hash of doc_id; the raw model counts every row.
    """
    good = labels.where("doc_id is not null and quality = 1").select(labels["doc_id"].cast("bigint").alias("id")).distinct()
    target = good.orderBy(F.xxhash64("id"), "id").limit(target_rows)
    wanted, every = _models(docs, target)
    ratio = np.log((wanted + SMOOTHING) / (wanted + SMOOTHING).sum()) - np.log((every + SMOOTHING) / (every + SMOOTHING).sum())
    shared = docs.sparkSession.sparkContext.broadcast(ratio if wanted.sum() else np.zeros_like(ratio))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for low, high in S.slices(batch.column(2)):
                buckets, row = _buckets(batch.column(2).slice(low, high - low))
                total[low:high] = np.bincount(row, shared.value[buckets], high - low)
                n[low:high] = np.bincount(row[:], minlength=high - low)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(total)], ["doc_id", "noise", "n_tokens", "log_weight"])

    text = docs["text"].cast("string")
    noise = F.xxhash64(docs["doc_id"].cast("bigint"), F.coalesce(text, F.lit("")), F.lit(seed)).alias("noise")
    scored = docs.select(docs["doc_id"].cast("bigint"), noise, text).mapInArrow(
        run, "doc_id bigint, noise bigint, n_tokens bigint, log_weight double")
    unit = (F.shiftrightunsigned("noise", 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = F.when(F.col("n_tokens") > 0, F.col("log_weight"))
    return scored.select(
        "doc_id", "n_tokens", weight.alias("log_weight"), (weight - F.log(-F.log(unit))).alias("draw"))


def resample(docs: DataFrame, labels: DataFrame, share: float = KEPT_SHARE, **settings) -> DataFrame:
    """(doc_id, n_tokens, log_weight, draw, kept) of every row of ``docs`` (doc_id, text): the k largest draws are kept.

    k is ``share`` of the rows with tokens, rounded down. ``labels`` has doc_id and quality. A null or
    empty text has no tokens, a null weight and is never kept. A null doc_id takes part and is never a
    target. Repeated rows draw alike, and rows that tie with the k-th are all kept. Without labels every
    weight is 0 and the draw is uniform; an empty table gives no rows. Other columns are ignored.

    The k-th draw is found by counting bins, without sorting all draws in one place.
    """
    rows = stored(importance(docs, labels, **settings), "importance")
    able = rows.where("draw is not null")
    n = able.count()
    k = int(n * share)
    if not k:
        return rows.withColumn("kept", F.lit(False))
    # the rank of the k-th largest from below, met without interpolation
    at = order_stats(able.withColumn("all", F.lit(1)), ["all"], "draw", [Percentile("least", (n - k) / max(n - 1, 1))])
    least = at.first()["least"]
    return rows.withColumn("kept", F.coalesce(F.col("draw") >= F.lit(least) - 1e-9, F.lit(False)))
