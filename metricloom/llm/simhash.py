"""SimHash near-duplicates: fingerprints, a segment-popcount grid join, and components.

A fingerprint is cut into segments and each segment is replaced by its number of one bits. The
Manhattan distance of two such vectors never exceeds the fingerprints' Hamming distance. If it is
at most 3, one half of the vector is at most 1 away, so the grid join looks up each half and its
neighbours one step up; the exact distance is verified inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.components import components
from metricloom.session import stored

BITS_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; zero if it has no word.

    Only A-Z are lower-cased and only ASCII white space separates; a text shorter than a shingle
    is one shingle. Signed, as Spark's bigint.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(shingle, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[at:at + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, key, fp) of every row; key is a hash of the text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.int64())], ["doc_id", "key", "fp"])

    return docs.select(docs["doc_id"].cast("bigint"), text_key(docs), docs["text"].cast("string")).mapInArrow(
        run, "doc_id bigint, key bigint, fp bigint")


def text_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("key")


def popcounts(half: Column, segment_bits: int = 2) -> Column:
    """The one bits of each segment of 32 bits, packed into the segment's own bits."""
    out, width, mask = half, 1, {1: 0x55555555, 2: 0x33333333, 4: 0x0F0F0F0F}
    while width < segment_bits:
        low = F.lit(mask[width]).cast("bigint")
        out = out.bitwiseAND(low) + F.shiftrightunsigned(out, width).bitwiseAND(low)
        width *= 2
    return out


def links(nodes: DataFrame, most: int = 3, segment_bits: int = 2) -> DataFrame:
    """(a, b) of all different fingerprints of ``nodes`` (column fp, distinct) at most ``most`` bits apart.

    ``most`` is at most 3: beyond, neither half need be within one step.
    """
    if not 0 <= most <= 3:
        raise ValueError("the two halves of the grid find distances of 0 to 3")
    per_half = 32 // segment_bits
    halves = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(h).alias("half"), popcounts(
            F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)), segment_bits).alias("cell"))
        for h in (0, 1)])).alias("at")).select("fp", "at.*")
    steps = []
    for j in range(per_half):
        field = F.shiftrightunsigned("cell", segment_bits * j).bitwiseAND(F.lit((1 << segment_bits) - 1))
        steps.append(F.when(field < segment_bits, F.col("cell") + F.lit(1 << (segment_bits * j))))
    probes = halves.select(
        F.col("fp").alias("a"), "half", F.col("cell").alias("own"), F.explode(F.array("cell", *steps)).alias("cell"),
    ).where("cell is not null")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return probes.join(halves.withColumnRenamed("fp", "b"), ["half", "cell"]).where(
        (apart <= most) & ((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b")))).select("a", "b")


def _classes(docs: DataFrame, shingle: int, seed: int, most: int, segment_bits: int) -> tuple[DataFrame, DataFrame]:
    """The stored (doc_id, key, fp) of all rows, and (fp, root, component_id) of all fingerprints."""
    rows = stored(fingerprints(docs, shingle, seed), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes, most, segment_bits), "simhash-links")
    at = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = at.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, at.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, most: int = 3,
                    segment_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``component_id`` is the smallest doc_id reachable over links, its own included. A null text is
    an empty one: fingerprint zero, linked like any other. A null doc_id takes part and counts as
    larger than any number; a component of such rows alone has a null id. Repeated rows stay and
    get equal results; an empty table gives no rows.

    Rows with one fingerprint are one node, so copies are never paired with each other.
    """
    rows, classes = _classes(docs, shingle, seed, most, segment_bits)
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    """The 16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = 3, seed: int = 42, most: int = 3,
                segment_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: one row of each component stays, with all its columns.

    That is the row of the smallest doc_id (null last) and then of the smallest text hash; of rows
    that agree in both, any one. Nulls, repeated rows and empty tables as in ``near_duplicates``.
    """
    rows, classes = _classes(docs, shingle, seed, most, segment_bits)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    alike = rows.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n"))
    best = alike.groupBy("fp").agg(F.min(place).alias("best")).join(classes, "fp").groupBy("root").agg(
        F.min("best").alias("best"))
    # an id and text hash stand for one fingerprint, so the winners are found among these alone
    winners = best.select(F.col("best.doc_id").alias("doc_id"), F.col("best.key").alias("key"), F.lit(True).alias("wins"))
    judged = stored(alike.join(
        winners, alike["doc_id"].eqNullSafe(winners["doc_id"]) & (alike["key"] == winners["key"]), "left",
    ).select(alike["doc_id"].alias("__id"), alike["key"].alias("__key"), "n", F.coalesce("wins", F.lit(False)).alias("wins")),
        "simhash-judged")
    marked = docs.withColumn("__key", text_key(docs))
    same = marked["doc_id"].cast("bigint").eqNullSafe(F.col("__id")) & (marked["__key"] == judged["__key"])
    out = marked.join(judged.where("not wins or n > 1"), same, "left_anti").select(*[marked[c] for c in docs.columns])
    repeated = judged.where("wins and n > 1")
    if not repeated.isEmpty():
        again = marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__key"])
        out = out.unionByName(again.select(*docs.columns))
    return out
