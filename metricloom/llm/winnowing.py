"""Benchmark decontamination by winnowing.

Both sides keep the smallest hash of every ``span - gram + 1`` consecutive word k-grams, so any
``span`` shared words leave the same fingerprint on both. Fingerprints are joined, and a hit is
extended word by word to both sides; a run of ``span`` words or more is contamination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm import segments as S
from metricloom.session import stored

SPAN, GRAM = 10, 6
FILTER_BITS = 1 << 25
MARK = "span int, hash bigint, start bigint, words array<string>, at int"


def _short(found: S.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    values, whole = S.grams(found.hashes(), found.row, size)
    at = np.flatnonzero(whole)
    return at, values[at]


def _marks(found: S.Words, at: np.ndarray, hashes: np.ndarray, span: int, gram: int) -> dict[str, list]:
    """Fingerprints with the words that any ``span`` words around them could hold."""
    reach = span - gram
    low = np.maximum(at - reach, found.first[found.row[at]])
    high = np.minimum(at + gram + reach, found.first[found.row[at] + 1])
    return {
        "row": found.row[at], "span": np.full(len(at), span), "hash": hashes.view(np.int64),
        "start": low - found.first[found.row[at]], "at": at - low,
        "words": [found.text(s, e).split(" ") for s, e in zip(low.tolist(), high.tolist(), strict=True)],
    }


def _joined(parts: list[dict]) -> dict[str, list]:
    return {k: [x for p in parts for x in p[k]] for k in ("row", "span", "hash", "start", "at", "words")}


def _item_marks(items: DataFrame, span: int, gram: int) -> DataFrame:
    """One row for each fingerprint of each item; an item of fewer than ``span`` words is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in S.slices(batch.column(1)):
                found = S.words(batch.column(1).slice(low, high - low), S.PUNCTUATION)
                hashes = found.hashes()
                at, values = S.minimizers(hashes, found.row, gram, span - gram + 1)
                parts = [_marks(found, at, values, span, gram)]
                for size in sorted({int(n) for n in found.counts if 0 < n < span}):
                    at, values = _short(found, size)
                    mine = found.counts[found.row[at]] == size
                    parts.append(_marks(found, at[mine], values[mine], size, size))
                made = _joined(parts)
                ids = batch.column(0).slice(low, high - low).take(pa.array(made["row"], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(made[k], t) for k, t in (
                        ("span", pa.int32()), ("hash", pa.int64()), ("start", pa.int64()),
                        ("words", pa.list_(pa.string())), ("at", pa.int32()))]],
                    ["item_id", "span", "hash", "start", "words", "at"])

    return items.select(items["item_id"].cast("string"), items["text"].cast("string")).mapInArrow(
        run, f"item_id string, {MARK}")


def _filter(marks: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the items' fingerprints, and the lengths of short items.

    Its size is fixed, whatever the benchmark's: it lets through every fingerprint of an item, and
    others only as often as bits are set. What passes is joined exactly.
    """
    cells = marks.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("bit")).groupBy(
        F.shiftright("bit", 6).cast("int").alias("cell"),
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    spans = sorted(r[0] for r in marks.select("span").distinct().collect())
    return bits.view(np.uint64), spans


def _document_marks(docs: DataFrame, bits, spans: list[int], span: int, gram: int) -> DataFrame:
    """(doc_id, key, n_words, marks) of every row; marks are fingerprints that some item may have."""
    kind = pa.list_(pa.struct([
        ("span", pa.int32()), ("hash", pa.int64()), ("start", pa.int64()),
        ("words", pa.list_(pa.string())), ("at", pa.int32())]))

    def known(values: np.ndarray) -> np.ndarray:
        bit = values % np.uint64(FILTER_BITS)
        return (bits.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in S.slices(batch.column(1)):
                texts = batch.column(1).slice(low, high - low)
                found = S.words(texts, S.PUNCTUATION)
                parts = []
                for size in spans:
                    if size == span:
                        at, values = S.minimizers(found.hashes(), found.row, gram, span - gram + 1)
                    else:
                        at, values = _short(found, size)
                    hit = known(values)
                    parts.append(_marks(found, at[hit], values[hit], size, gram if size == span else size))
                made = _joined(parts)
                order = np.argsort(np.array(made["row"], np.int64), kind="stable")
                sizes = np.bincount(np.array(made["row"], np.int64), minlength=len(texts))
                flat = pa.StructArray.from_arrays(
                    [pa.array([made[f.name][i] for i in order], f.type) for f in kind.value_type], fields=list(kind.value_type))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low),
                     pa.array(found.counts, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                    ["doc_id", "key", "n_words", "marks"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string"), text_key(docs)).mapInArrow(
        run, f"doc_id bigint, key binary, n_words bigint, marks array<struct<{MARK.replace(' ', ':').replace(',:', ',')}>>")


def text_key(docs: DataFrame) -> Column:
    """A 128-bit key of the text, equal for null and empty ones."""
    return F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))).alias("key")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items) of every row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased. A window is
    ``span`` consecutive words of an item, or all words of an item that has fewer. ``n_hit`` counts
    the document's words inside any occurrence of a window, ``items`` is the sorted array of the
    item_ids (as strings) whose windows occur. ``key`` is a hash of the text.

    A null or empty text has no words and no hits; an item without words has no window; a null
    item_id counts its words but names no item. Repeated rows each get their result. Without
    documents there are no rows, without items no hits. Other columns are ignored.
    """
    spark = docs.sparkSession
    marks = stored(_item_marks(items, span, gram), "benchmark-marks")
    bits, spans = _filter(marks)
    shared = spark.sparkContext.broadcast(bits)
    rows = stored(_document_marks(docs, shared, spans, span, gram), "document-marks")

    # an occurrence of a fingerprint in one text is looked up once, whatever the copies of the text
    hits = rows.where(F.size("marks") > 0).select("key", F.explode("marks").alias("m")).select("key", "m.*").groupBy(
        "key", "span", "hash", "start", "words", "at").agg(F.lit(1).alias("one")).drop("one")
    # equal surroundings in several items are one entry of the index
    index = marks.groupBy("span", "hash", "words", "at").agg(
        F.sort_array(F.collect_set("item_id")).alias("ids")).withColumnsRenamed({"words": "theirs", "at": "there"})
    met = hits.join(index, ["span", "hash"])
    # words in common before the fingerprint, and from it on
    left = F.expr("""aggregate(sequence(1, greatest(least(at, there), 1)), 0, (n, j) ->
        if(n = j - 1 and j <= at and j <= there and words[at - j] = theirs[there - j], j, n))""")
    right = F.expr("""aggregate(sequence(0, greatest(least(size(words) - at, size(theirs) - there), 1) - 1), 0, (n, j) ->
        if(n = j and words[at + j] = theirs[there + j], j + 1, n))""")
    runs = met.withColumns({"l": left, "r": right}).where("l + r >= span").select(
        "key", (F.col("start") + F.col("at") - F.col("l")).alias("low"),
        (F.col("start") + F.col("at") + F.col("r")).alias("high"), "ids")
    spans_of = runs.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("runs"))
    named = runs.select("key", F.explode("ids").alias("item")).groupBy("key").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.expr("""aggregate(runs, named_struct('n', 0L, 'to', 0L), (s, x) -> named_struct(
        'n', s.n + greatest(0L, x.high - greatest(s.to, x.low)), 'to', greatest(s.to, x.high)), s -> s.n)""")
    judged = spans_of.join(named, "key", "left").select("key", covered.alias("n_hit"), "items")
    return rows.select("doc_id", "key", "n_words").join(judged, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window, with all their columns.

    Equal texts go together, whatever their ids; null and empty texts stay; an empty table gives no rows.
    """
    bad = contamination(docs, items, span, gram).where("n_hit > 0").select(F.col("key").alias("bad")).distinct()
    return docs.join(bad, text_key(docs) == bad["bad"], "left_anti")
