"""Hard negatives by threshold joins over inverted indexes, in the manner of L2AP.

Anchors are searched against all rows in a grid of blocks. A task holds one block of anchors and one block of rows
and builds an index of its rows: dimensions are put in order of their energy, and a row's last dimensions are left out
of the index as long as their norm alone, times the largest norm of the anchors there, stays below the threshold. The
inverted list of a dimension holds the rows that reach it; rows are sorted by how far they reach, so every
list is a prefix. Partial scores add up list by list; a pair whose partial score and remaining norms can't reach
the anchor's threshold is dropped, the others are finished exactly in integers. Thresholds begin high and are lowered,
with a new index each time, until every window of the block is full or its lower end is reached.

A block's best are among its own first few, so the best of all blocks are found by merging those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.session import stored

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
# a negative has 50 to 95 hundredths of the positive's score
LOW, HIGH = 50, 95
SCALE = 256
# rows and anchors of a block of the grid, and the bytes that either may have
ROW_BLOCK, ANCHOR_BLOCK, BLOCK_BYTES = 1 << 15, 1 << 10, 16 << 20
# thresholds tried from the highest to the lowest
LEVELS = 5
# dimensions added between two looks at the bounds, and anchors looked at together
STRIDE, TOGETHER = 16, 64
# rows of a larger integer norm have scores beyond 64 bits
MOST_NORM = float(1 << 62)


def prepared(embeddings: DataFrame, label_shift: bool = True) -> DataFrame:
    """(uid, vec_id, label, vector) of the rows that take part, stored; vector holds 64-bit integers floor(256 x).

    ``uid`` tells repeated rows apart. With ``label_shift``, a label whose vec_id is divisible by 7 is the next of ten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, vectors = [], []
            for row, vector in enumerate(batch.column(2)):
                if vector.values is None or vector.values.null_count:
                    continue
                values = np.floor(SCALE * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(values).all() and values @ values < MOST_NORM:
                    kept.append(row)
                    vectors.append(values.astype(np.int64).tobytes())
            taken = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), pa.array(vectors, pa.binary())], ["vec_id", "label", "vector"])

    label = F.col("label").cast("bigint")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label) if label_shift else label
    rows = embeddings.select(
        embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["label"],
        embeddings["embedding"].cast("array<double>").alias("vector"),
    ).where("label is not null and vector is not null").select("vec_id", shifted.alias("label"), "vector").mapInArrow(
        run, "vec_id bigint, label bigint, vector binary")
    return stored(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "vector"), "vectors")


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    vectors = [np.frombuffer(v, np.int64) for v in column.to_pylist()]
    out = np.zeros((len(vectors), max([width or 0, *map(len, vectors)])), np.int64)
    for row, vector in enumerate(vectors):
        out[row, :len(vector)] = vector
    return out


class Index:
    """An inverted index of rows for one threshold and the anchors' norms.

    ``energy`` orders the dimensions; ``reach`` is how many of them a row has in the index.
    """

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, threshold: float):
        energy = np.einsum("ij,ij->j", rows, rows, dtype=np.float64)
        self.order = np.argsort(-energy, kind="stable")
        self.rows, self.anchors = rows[:, self.order].astype(np.float64), anchors[:, self.order].astype(np.float64)
        self.row_rest, self.anchor_rest = _rest(self.rows), _rest(self.anchors)
        most = self.anchor_rest.max(axis=0, initial=0.0)
        # a row reaches the first dimension from which on its remaining norm can't give the threshold
        below = self.row_rest * most < threshold
        self.reach = np.where(below.any(axis=1), below.argmax(axis=1), self.rows.shape[1])
        self.slots = np.argsort(-self.reach, kind="stable")
        self.rows, self.row_rest = self.rows[self.slots], self.row_rest[self.slots]
        self.reach = self.reach[self.slots]
        width = self.rows.shape[1]
        # the length of every list
        self.lengths = np.searchsorted(-self.reach, -np.arange(width), "left")

    def candidates(self, low: int, high: int, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) pairs of the anchors from ``low`` to ``high`` whose bounds reach the anchor's threshold."""
        width = self.rows.shape[1]
        partial = np.zeros((high - low, len(self.rows)))
        slack = 1e-9 * self.anchor_rest[low:high, :1] * self.row_rest[:, 0].max(initial=0.0) + 1e-6
        floor = thresholds[:, None] - slack
        alive: tuple[np.ndarray, np.ndarray] | None = None
        for start in range(0, width, STRIDE):
            end = min(start + STRIDE, width)
            listed = self.lengths[start] if start < width else 0
            if alive is None:
                for first, last in _levels(self.lengths, start, end):
                    n = self.lengths[first]
                    partial[:, :n] += self.anchors[low:high, first:last] @ self.rows[:n, first:last].T
                # a row with a shorter list has the norm of all it hasn't added yet
                done = np.minimum(self.reach, end)
                rest = np.take_along_axis(self.row_rest, done[:, None], 1)[:, 0]
                bound = partial + _rest_at(self.anchor_rest[low:high], done) * rest
                found = np.nonzero(bound >= floor)
                if len(found[0]) * 8 < partial.size or not listed:
                    alive = found
            else:
                a, r = alive
                reach = self.reach[r]
                dims = np.arange(start, end)
                own = np.where(dims < reach[:, None], self.rows[r[:, None], dims], 0.0)
                partial[a, r] += np.einsum("ij,ij->i", own, self.anchors[low + a][:, start:end])
                done = np.minimum(reach, end)
                bound = partial[a, r] + self.anchor_rest[low + a, done] * self.row_rest[r, done]
                keep = bound >= floor[a, 0]
                alive = a[keep], r[keep]
        if alive is None:
            alive = np.nonzero(partial + _rest_at(self.anchor_rest[low:high], self.reach) * np.take_along_axis(
                self.row_rest, self.reach[:, None], 1)[:, 0] >= floor)
        return alive[0] + low, self.slots[alive[1]]


def _rest(vectors: np.ndarray) -> np.ndarray:
    """Norms of what is left from every dimension on; one column more than there are dimensions."""
    out = np.zeros((len(vectors), vectors.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(vectors[:, ::-1] ** 2, axis=1)[:, ::-1])
    return out


def _rest_at(rest: np.ndarray, done: np.ndarray) -> np.ndarray:
    return rest[:, done]


def _levels(lengths: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of dimensions whose lists have one length."""
    first = start
    for at in range(start + 1, end + 1):
        if at == end or lengths[at] != lengths[first]:
            yield first, at
            first = at


def _best(score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` by score descending, vec_id and uid."""
    return np.lexsort((uid, vec_id, -score))[:n]


def _known(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = table["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    return table["uid"].to_numpy(), ids, table["label"].to_numpy(), _matrix(table["vector"])


def _widened(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(left.shape[1], right.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (left, right))


def _joined(rows: np.ndarray, anchors: np.ndarray, levels: np.ndarray, take) -> None:
    """Call ``take(anchor, rows, scores, level, last)`` with all rows that reach a level of the anchor, level by level
    downwards until it returns true or the last level is done."""
    open_ones = np.arange(len(anchors))
    for step in range(levels.shape[1]):
        if not len(open_ones):
            return
        level, last = levels[:, step], step == levels.shape[1] - 1
        index = Index(rows, anchors[open_ones], float(level[open_ones].min()))
        still = []
        for low in range(0, len(open_ones), TOGETHER):
            high = min(low + TOGETHER, len(open_ones))
            a, r = index.candidates(low, high, level[open_ones[low:high]])
            scores = _products(anchors[open_ones], a, rows, r)
            order = np.argsort(a, kind="stable")
            a, r, scores = a[order], r[order], scores[order]
            cut = np.searchsorted(a, np.arange(low, high + 1))
            for i in range(low, high):
                anchor, part = open_ones[i], slice(cut[i - low], cut[i - low + 1])
                reached = scores[part] >= level[anchor]
                if not take(anchor, r[part][reached], scores[part][reached], level[anchor], last):
                    still.append(anchor)
        open_ones = np.array(still, np.int64)


def _products(anchors: np.ndarray, a: np.ndarray, rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer inner products of pairs, some at a time."""
    out = np.zeros(len(a), np.int64)
    for low in range(0, len(a), 1 << 16):
        part = slice(low, low + (1 << 16))
        out[part] = np.einsum("ij,ij->i", anchors[a[part]], rows[r[part]])
    return out


def _blocks(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides on a grid of (row block, anchor block); every block of one side meets every block of the other."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("vector")), F.lit(0)).alias("bytes")).first()
    most = max(1, BLOCK_BYTES // max(size["bytes"], 1))
    row_blocks, anchor_blocks = (-(-n // min(block, most)) or 1 for n, block in ((size["n"], ROW_BLOCK), (anchors.count(), ANCHOR_BLOCK)))

    def dealt(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    return (dealt(rows, "rb", row_blocks, "ab", anchor_blocks), dealt(anchors, "ab", anchor_blocks, "rb", row_blocks))


def positives(rows: DataFrame, anchors: DataFrame, n: int = POSITIVES) -> DataFrame:
    """(anchor, anchor_id, positive, positive_id, score): each anchor's first ``n`` other rows of its label."""

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            return _table([], ["anchor", "row", "score"])
        uid, ids, label, vectors = _known(mine)
        a_uid, a_ids, a_label, a_vectors = _known(theirs)
        vectors, a_vectors = _widened(vectors, a_vectors)
        out: list[tuple] = []
        for value in np.unique(a_label):
            at, own = np.flatnonzero(label == value), np.flatnonzero(a_label == value)
            if not len(at):
                continue
            norms = np.sqrt((vectors[at].astype(np.float64) ** 2).sum(axis=1)).max()
            most = np.sqrt((a_vectors[own].astype(np.float64) ** 2).sum(axis=1)) * norms
            levels = most[:, None] * np.append(np.linspace(0.8, 0.2, LEVELS - 1), 0.0)
            levels[:, -1] = -np.inf

            def take(anchor: int, found: np.ndarray, scores: np.ndarray, level: float, last: bool, own=own, at=at) -> bool:
                other = uid[at[found]] != a_uid[own[anchor]]
                found, scores = found[other], scores[other]
                best = _best(scores, ids[at[found]], uid[at[found]], n)
                full = last or len(best) == n
                if full:
                    out.extend((a_uid[own[anchor]], uid[at[found[b]]], scores[b]) for b in best)
                return full

            _joined(vectors[at], a_vectors[own], levels, take)
        return _table(out, ["anchor", "row", "score"])

    return _ranked(_search(rows, anchors, search, "anchor bigint, row bigint, score bigint"), rows, ["anchor"], n)


def _table(out: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array([int(r[i]) for r in out], pa.int64()) for i in range(len(names))], names)


def _search(rows: DataFrame, anchors: DataFrame, search, kind: str) -> DataFrame:
    # both sides may come from one table; new names tell their columns apart
    mine, theirs = (side.toDF(*side.columns) for side in _blocks(rows, anchors))
    return mine.groupBy("rb", "ab").cogroup(theirs.groupBy("rb", "ab")).applyInArrow(search, kind)


def _ranked(found: DataFrame, rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` of all blocks for each key, with the vec_id of the row found; a key has ``n`` rows from a block."""
    named = found.join(rows.select(F.col("uid").alias("row"), F.col("vec_id").alias("row_id")), "row")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("row_id").asc_nulls_last(), "row")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def negatives(rows: DataFrame, pairs: DataFrame, n: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor, positive, row, row_id, score, rank): of each pair the first ``n`` rows of another label that have ``low`` to
    ``high`` hundredths of the positive's score. ``pairs``: uid, vec_id, label and vector of an anchor, ``windows``, an array
    of (positive, score)."""

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            return _table([], ["anchor", "positive", "row", "score"])
        uid, ids, label, vectors = _known(mine)
        a_uid, _, a_label, a_vectors = _known(theirs)
        vectors, a_vectors = _widened(vectors, a_vectors)
        # the ends of an anchor's windows, rounded inwards; Python's integers don't overflow
        windows = [[(w["positive"], -(-low * w["score"] // 100), high * w["score"] // 100) for w in ws]
                   for ws in theirs["windows"].to_pylist()]
        windows = [[w for w in ws if w[1] <= w[2]] for ws in windows]
        own = np.flatnonzero([len(ws) > 0 for ws in windows])
        out: list[tuple] = []
        if not len(own):
            return _table(out, ["anchor", "positive", "row", "score"])
        top = np.array([max(w[2] for w in windows[i]) for i in own], np.float64)
        # a little lower, as the ends may not be exact as floats; the windows are compared as integers
        bottom = np.array([min(w[1] for w in windows[i]) for i in own], np.float64)
        bottom -= np.abs(bottom) * 1e-12 + 1
        levels = bottom[:, None] + (top - bottom)[:, None] * np.append(np.linspace(0.9, 0.25, LEVELS - 1), 0.0)

        def take(anchor: int, found: np.ndarray, scores: np.ndarray, level: float, last: bool) -> bool:
            other = label[found] != a_label[own[anchor]]
            found, scores = found[other], scores[other]
            order = _best(scores, ids[found], uid[found], len(found))
            made, full = [], True
            for positive, least, most in windows[own[anchor]]:
                fits = order[(scores[order] >= least) & (scores[order] <= most)][:n]
                full &= len(fits) == n or level <= least
                made += [(a_uid[own[anchor]], positive, uid[found[f]], scores[f]) for f in fits]
            if full or last:
                out.extend(made)
            return full or last

        _joined(vectors, a_vectors[own], levels, take)
        return _table(out, ["anchor", "positive", "row", "score"])

    found = _search(rows, pairs, search, "anchor bigint, positive bigint, row bigint, score bigint")
    return _ranked(found, rows, ["anchor", "positive"], n)


def hard_negatives(embeddings: DataFrame, every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``embeddings`` (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by ``every``, searched against all rows by the integer inner product
    of floor(256 x). Positives are the first ``n_positives`` other rows of the anchor's label, negatives the first
    ``n_negatives`` of other labels with ``low`` to ``high`` hundredths of the positive's score; ties go to the smaller vec_id.

    Rows with a null label or vector or a null or non-finite component take no part, nor do those whose integer norm
    passes 2^31, as their scores don't fit 64 bits. Shorter vectors count as ending in zeros. A null vec_id is
    no anchor and comes last in ties. Repeated rows are rows of their own, also as positives of each other. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = prepared(embeddings)
    anchors = rows.where(F.col("vec_id") % every == 0)
    pairs = stored(positives(rows, anchors, n_positives).select(
        "anchor", F.col("row").alias("positive"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = pairs.groupBy("anchor").agg(F.collect_list(F.struct("positive", F.col("positive_score").alias("score"))).alias("windows"))
    held = anchors.join(windows, F.col("uid") == F.col("anchor")).drop("anchor")
    found = negatives(rows, held, n_negatives, low, high).select(
        "anchor", "positive", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return found.join(pairs, ["anchor", "positive"]).join(
        anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
