"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed character 3- to 5-grams, a passage the mean of
its words, and a two-class softmax sits on top. A document is as toxic as its passages are
together (the log of their summed odds), so one insult in a long text still counts. Words never seen
in training share n-grams with known ones.

Since every step up to a passage's odds is linear, a trained model folds into one number for each
bucket; scoring is look-ups and sums over arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm import chargrams as C
from metricloom.llm import segments as S

SIZES = (3, 4, 5)
BITS = 17
DIMENSION = 8
PASSAGE = 8
# the bound of what is fitted in one process: documents of a label, and characters of them all
TRAIN_ROWS, TRAIN_CHARACTERS = 1_500, 6_000_000
EPOCHS, RATE, DECAY, NEGATIVE_WEIGHT = 60, 0.05, 2e-5, 2.0


@dataclass
class Bags:
    """Distinct words as gram lists, passages as word lists, documents as passage lists."""

    grams: np.ndarray
    gram_first: np.ndarray
    words: np.ndarray
    passage_first: np.ndarray
    passage_row: np.ndarray
    rows: int


def _places(chars: C.Characters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its row."""
    inside = chars.codes > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return starts, ends, np.searchsorted(chars.first, starts, "right") - 1


def _passages(row: np.ndarray, rows: int) -> np.ndarray:
    """The first word of every run of PASSAGE words of a row."""
    first = np.searchsorted(row, np.arange(rows))
    return np.flatnonzero((np.arange(len(row)) - first[row]) % PASSAGE == 0) if len(row) else np.zeros(0, np.int64)


def bags(texts: pa.Array) -> Bags:
    # word by word, slice by slice; a word is known by its hash
    names: dict[int, str] = {}
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for low, high in S.slices(texts, S.SLICE_BYTES // 4):
        chars = C.characters(texts.slice(low, high - low))
        starts, ends, row = _places(chars)
        hashes.append(S.place_hashes(S.mixed(chars.codes.astype(np.uint64) + np.uint64(1)), starts, ends))
        rows.append((low + row).astype(np.int32))
        for name, at in zip(*np.unique(hashes[-1], return_index=True), strict=True):
            if name not in names:
                names[int(name)] = chars.codes[starts[at]:ends[at]].tobytes().decode("utf-32-le")
    known = np.sort(np.array(list(names), np.uint64))
    words = np.concatenate([np.searchsorted(known, h).astype(np.int32) for h in hashes])
    row = np.concatenate(rows)
    del hashes, rows
    # n-grams of the distinct words alone, each word a row of its own
    own = C.characters(pa.array([names[h] for h in known.tolist()], pa.string()))
    del names
    grams, first = _word_grams(own, len(known))
    passages = _passages(row, len(texts))
    return Bags(grams, first, words, passages, row[passages], len(texts))


def _word_grams(own: C.Characters, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, word after word, and where each word's begin; held in 32 bits as there are millions."""
    parts, sizes = [], np.zeros(n, np.int64)
    for bucket, counts in C.grams(own, SIZES, BITS):
        places = np.flatnonzero(counts)
        word = (np.searchsorted(own.first, places, "right") - 1).astype(np.int32)
        parts.append((word, bucket[places].astype(np.int32)))
        sizes += np.bincount(word, minlength=n)
    first = np.concatenate([[0], np.cumsum(sizes)])
    grams, upto = np.zeros(first[-1], np.int32), first[:-1].copy()
    for word, bucket in parts:
        count = np.bincount(word, minlength=n)
        # a size's grams come in the order of the words, so each knows its place among its word's
        grams[upto[word] + np.arange(len(word)) - (np.cumsum(count) - count)[word]] = bucket
        upto += count
    return grams, first


def _sums(values: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per dimension, sums of ``values[at]`` over the runs that begin at ``first``."""
    return np.stack([np.add.reduceat(v[at], first) for v in values])


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax together by Adam over all examples; returns bucket weights and a bias."""
    made = bags(texts)
    weights = np.zeros(1 << BITS, np.float32)
    if not len(made.words) or len(set(toxic.tolist())) < 2:
        rate = (float(np.sum(toxic)) + 0.5) / (len(toxic) + 1.0)
        return weights, float(np.log(rate / (1 - rate)))
    rng = np.random.default_rng(seed)
    active = np.flatnonzero(np.bincount(made.grams, minlength=1 << BITS))
    slot = np.zeros(1 << BITS, np.int32)
    slot[active] = np.arange(len(active))
    grams = slot[made.grams]
    n_grams = np.diff(made.gram_first)
    owner = np.repeat(np.arange(len(n_grams), dtype=np.int32), n_grams)[np.argsort(grams, kind="stable")]
    by_gram = np.cumsum(np.bincount(grams, minlength=len(active))) - np.bincount(grams, minlength=len(active))
    n_words = np.diff(np.concatenate([made.passage_first, [len(made.words)]]))
    passage_of_word = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
    row_first = np.flatnonzero(np.diff(made.passage_row, prepend=-1))
    seen = made.passage_row[row_first]
    passage_slot = np.repeat(np.arange(len(row_first)), np.diff(np.concatenate([row_first, [len(n_words)]])))
    y = toxic[seen].astype(np.float32)
    cost = np.where(y > 0, 1.0, NEGATIVE_WEIGHT).astype(np.float32)
    cost /= cost.sum()
    params = {
        "e": rng.normal(0, 0.1, (DIMENSION, len(active))).astype(np.float32),
        "w": rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32), "b": np.array([-3.0], np.float32)}
    moment = {k: np.zeros_like(v) for k, v in params.items()}
    spread = {k: np.zeros_like(v) for k, v in params.items()}
    for step in range(1, EPOCHS + 1):
        e, w, b = params["e"], params["w"], params["b"]
        vectors = _sums(e, grams, made.gram_first[:-1]) / n_grams
        odds = (w[:, 1] - w[:, 0]) @ vectors
        passage = np.add.reduceat(odds[made.words], made.passage_first) / n_words
        top = np.maximum.reduceat(passage, row_first)
        lift = np.exp(passage - top[passage_slot])
        total = np.add.reduceat(lift, row_first)
        p = 1 / (1 + np.exp(-np.clip(top + np.log(total) + b[0], -60, 60)))
        error = (p - y) * cost
        d_passage = error[passage_slot] * lift / total[passage_slot]
        d_word = np.bincount(made.words, (d_passage / n_words)[passage_of_word], len(n_grams)).astype(np.float32)
        # one row of the gradient for each class, equal but for the sign
        d_class = np.stack([-d_word, d_word])
        d_vector = (w @ d_class) / n_grams
        slope = {
            "w": vectors @ d_class.T, "b": np.array([error.sum()], np.float32),
            "e": _sums(d_vector, owner, by_gram) + DECAY * e}
        for k in params:
            moment[k] = 0.9 * moment[k] + 0.1 * slope[k]
            spread[k] = 0.99 * spread[k] + 0.01 * slope[k] ** 2
            params[k] = params[k] - RATE * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(spread[k] / (1 - 0.99 ** step)) + 1e-8)
    weights[active] = (params["w"][:, 1] - params["w"][:, 0]) @ params["e"]
    return weights, float(params["b"][0])


def score(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of each text; without a word, 0."""
    out = np.zeros(len(texts))
    for low, high in S.slices(texts, S.SLICE_BYTES // 2):
        chars = C.characters(texts.slice(low, high - low))
        starts, ends, row = _places(chars)
        if not len(starts):
            continue
        sums, counts = np.zeros(len(chars.codes) + 1), np.zeros(len(chars.codes) + 1)
        for bucket, counted in C.grams(chars, SIZES, BITS):
            sums[1:len(bucket) + 1] += np.where(counted, weights[bucket], 0)
            counts[1:len(bucket) + 1] += counted
        sums, counts = np.cumsum(sums), np.cumsum(counts)
        # a word's grams start at the place before it and end at the place behind it
        word = (sums[ends - 1] - sums[starts - 1]) / np.maximum(counts[ends - 1] - counts[starts - 1], 1)
        first = _passages(row, len(chars))
        passage = np.add.reduceat(word, first) / np.diff(np.concatenate([first, [len(word)]]))
        row_first = np.flatnonzero(np.diff(row[first], prepend=-1))
        top = np.maximum.reduceat(passage, row_first)
        slot = np.repeat(np.arange(len(row_first)), np.diff(np.concatenate([row_first, [len(first)]])))
        odds = top + np.log(np.add.reduceat(np.exp(passage - top[slot]), row_first)) + bias
        out[low + row[first][row_first]] = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_CHARACTERS) -> pa.Table:
    """(text, toxic) of up to ``rows`` labelled documents for each label that aren't held out.

    Documents are taken whole and of any length, in the order of a hash of doc_id, so reruns agree; one that
    would bring its label beyond ``most`` characters is passed over. These two bounds are all that one
    process ever holds.
    """
    known = labels.select(labels["doc_id"].cast("bigint").alias("id"), labels["toxic"].cast("int").alias("toxic")).where(
        "id is not null and toxic in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = docs.where(docs["text"].isNotNull()).select(
        docs["doc_id"].cast("bigint").alias("doc_id"), F.length(docs["text"].cast("string")).cast("bigint").alias("size"))
    usable = known.join(sizes, known["id"] == sizes["doc_id"]).groupBy("id", "toxic").agg(F.sum("size").alias("size")).where(
        F.col("size") <= most)
    ids, marks = [], []
    for label in (0, 1):
        held = 0
        for row in usable.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(rows).collect():
            if held + row["size"] <= most:
                held += row["size"]
                ids.append(row["id"])
                marks.append(label)
    chosen = docs.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "toxic": pa.array(marks, pa.int32())}))
    texts = docs.where(docs["text"].isNotNull()).select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"])
    return found.orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text").select("text", "toxic").toArrow()


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, key, score, predicted) of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic).

    Only labels of documents with crc32(doc_id) mod 5 other than 0 are learned; nothing but the text
    is scored. A null or empty text, or one without a word, scores 0. A null doc_id is scored and
    never learned; an id with two labels counts as toxic; repeated rows score alike. Without labels
    of both kinds every text with words scores their rate. A text of any length is scored whole, with some 100 bytes a
    character in one task while it is. Other columns are ignored.
    """
    table = examples(docs, labels)
    weights, bias = train(table["text"].combine_chunks(), table["toxic"].to_numpy())
    # its size is fixed by BITS
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = score(batch.column(2), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made), pa.array((made >= 0.5).astype(np.int32))],
                ["doc_id", "key", "score", "predicted"])

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("bigint"), F.xxhash64(text).alias("key"), docs["text"].cast("string")).mapInArrow(
        run, "doc_id bigint, key bigint, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, whatever their names.

    Equal texts, repeated rows too, go together; null, empty and wordless texts score 0 and stay, null ids are judged
    like others, and an empty table gives no rows.
    """
    toxic = scores(docs, labels).where("predicted = 1").select(F.col("key").alias("bad")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(toxic, key == toxic["bad"], "left_anti")
