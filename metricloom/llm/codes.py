"""Token ids as directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, level 1
the second chunk of those ids that have one, and so on. A bitmap beside each level marks the ids
that go on, and a directory of the bitmap's running counts, one for each 512 bits, tells where:
token i is read by one step in each level, with no block to decode.

Codes are stored as rows of Parquet, one for each shard of consecutive documents:
part and shard (their order), n_tokens, doc_ids, ends (each document's end in the shard) and codes:
  uint32 number of levels; for each level uint32 entries and then its chunks (1 byte each), its
  bitmap (entries / 8 bytes, rounded up, lowest bit first) and its directory (uint32 each).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.session import stored

SHARD_TOKENS = 1 << 18
BLOCK = 512
CACHED_WORDS = 800_000
_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint32)

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# a byte-level pre-tokenizer always cuts here: before a lone blank, after a word, around a lone line end
BLANK = re.compile(r"(?<=\S)(?= \S)")
INNER = re.compile(rf"(?<=[{LETTERS}])(?=[.,])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def encode(ids: np.ndarray) -> bytes:
    """The codes of an array of ids from 0 to 2**32 - 1."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, rest = (rest & 255).astype(np.uint8), rest >> 8
        goes_on = rest > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        padded = np.zeros(-(-max(len(bitmap), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[:len(bitmap)] = bitmap
        counts = _COUNTS[padded].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        levels.append(np.uint32(len(chunk)).tobytes() + chunk.tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[goes_on]
        if not len(rest):
            return np.uint32(len(levels)).tobytes() + b"".join(levels)


class Codes:
    """Reads codes; ``codes[i]`` is token i."""

    def __init__(self, held: bytes):
        at, self.levels = 4, []
        for _ in range(int(np.frombuffer(held, "<u4", 1)[0])):
            n = int(np.frombuffer(held, "<u4", 1, at)[0])
            blocks, at = max(1, -(-n // BLOCK)), at + 4
            chunk = np.frombuffer(held, np.uint8, n, at)
            bitmap = np.frombuffer(held, np.uint8, -(-n // 8), at + n)
            directory = np.frombuffer(held, "<u4", blocks, at + n + len(bitmap))
            at += n + len(bitmap) + 4 * blocks
            self.levels.append((chunk, bitmap, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for depth, (chunk, bitmap, directory) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * depth)
            byte, bit = i >> 3, i & 7
            if not bitmap[byte] >> bit & 1:
                break
            first = i // BLOCK * (BLOCK // 8)
            i = int(directory[i // BLOCK]) + int(_COUNTS[bitmap[first:byte]].sum()) + int(
                _COUNTS[bitmap[byte] & ((1 << bit) - 1)])
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for chunk, bitmap, _ in reversed(self.levels):
            up = np.flatnonzero(np.unpackbits(bitmap, count=len(chunk), bitorder="little"))
            here = chunk.astype(np.uint32)
            here[up] |= value << np.uint32(8)
            value = here
        return value


def _byte_characters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself if it prints, else one from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _NotLone(Exception):
    """White space stands beside a blank, so the text must be cut with more care."""


class _Pieces(dict):
    """Ids, as bytes, of what stands between blanks, with the blank before it; made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.marks: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        """What is cut inside of a piece: a word, kept as the piece it is, or anything else."""
        if part[0] == " " and part[1:].isalpha():
            return self[part[1:]]
        found = self.marks.get(part)
        if found is None:
            if len(self.marks) >= CACHED_WORDS // 8:
                self.marks.clear()
            found = self.marks[part] = self.make(part)
        return found

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _NotLone
        if len(self) >= CACHED_WORDS:
            self.clear()
        if piece.isalpha():
            found = self.make(" " + piece)
        else:
            found = b"".join(map(self.part, INNER.split(" " + piece)))
        self[piece] = found
        return found


class Encoder:
    """A byte-level tokenizer that tokenizes a word once and keeps its ids as bytes.

    Texts are cut only where the tokenizer's own pre-tokenizer must cut, so the ids are those of the
    whole text. The words kept are bounded; when they are too many, keeping starts anew.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.characters = dict(enumerate(_byte_characters()))
        self.blank = self.characters[32]
        self.pieces = _Pieces(self.word)

    def word(self, word: str) -> bytes:
        """The ids of a part that the pre-tokenizer cuts off; letters are one part, which the model takes as it is."""
        letters = word[1:] if word[:1] == " " else word
        if not letters.isalpha():
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        elif word.isascii():
            ids = [token.id for token in self.model.tokenize(word.replace(" ", self.blank))]
        else:
            written = word.encode().decode("latin-1").translate(self.characters)
            ids = [token.id for token in self.model.tokenize(written)]
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each, in the machine's order."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _NotLone
            tail = b"".join(map(self.pieces.__getitem__, rest))
        except _NotLone:
            return b"".join([self.word(w) for piece in BLANK.split(text) for w in INNER.split(piece)])
        return b"".join([self.word(w) for w in INNER.split(first)]) + tail


_ENCODERS: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """One for each worker process, so that it keeps its words between tasks."""
    name = hash(definition)
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(definition)
    return _ENCODERS[name]


def write_tokens(docs: DataFrame, path: str, definition: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS,
                 order: str | None = None) -> None:
    """Tokenize ``docs`` (doc_id, text) and write codes to ``path`` in ascending doc_id order.

    With ``order``, a column of ``docs`` such as a position in training, its order comes before that of doc_id.

    ``definition`` is the JSON of a byte-level tokenizer. ``end_id`` follows every document. A null
    text is an empty one; a null doc_id comes first; rows of one doc_id come in the order of a hash of
    their texts. A document is never cut, so a shard holds ``shard_tokens`` or one longer document.
    Without documents the folder has no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def shard(part: int, number: int, ids: list, held: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(h) // 4 for h in held])
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([int(ends[-1])], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())),
            pa.array([encode(np.frombuffer(b"".join(held), np.uint32))], pa.binary()),
        ], ["part", "shard", "n_tokens", "doc_ids", "ends", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(shared.value), TaskContext.get().partitionId(), 0
        end = array("I", [end_id]).tobytes()
        ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = encoder(text.as_py() or "") + end
                if held and size + len(made) > 4 * shard_tokens:
                    yield shard(part, number, ids, held)
                    ids, held, size, number = [], [], 0, number + 1
                ids.append(doc_id)
                held.append(made)
                size += len(made)
        if held:
            yield shard(part, number, ids, held)

    first = [] if order is None else [docs[order].alias("place")]
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), *first,
    ).withColumn("tie", F.xxhash64("text"))
    keys = [*(["place"] if first else []), "doc_id", "tie"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select(
        "doc_id", "text",
    ).mapInArrow(
        run, "part int, shard int, n_tokens bigint, doc_ids array<bigint>, ends array<bigint>, codes binary",
    ).write.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, start, n_tokens): tokens of all shards before each one, added up part by part."""
    shards = spark.read.parquet(path).select("part", "shard", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    earlier = F.coalesce(F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(
        F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("inside", inside).join(parts.select("part", earlier.alias("earlier")), "part").select(
        "part", "shard", (F.col("earlier") + F.col("inside")).alias("start"), "n_tokens")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    ``start`` counts the ids of all documents before it; the checksum is of its ids as little-endian
    unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, ends, codes in zip(*batch.columns, strict=True):
                held, ends = Codes(codes.as_py()).all().astype("<u4").tobytes(), np.array(ends.as_py(), np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([
                    doc_ids.values, pa.array(starts + first.as_py()), pa.array(ends - starts),
                    pa.array([zlib.crc32(held[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.parquet(path)
    # the starts are a narrow table of their own, so that the codes needn't move to meet them
    starts = stored(shard_starts(spark, path).drop("n_tokens"), "token-starts")
    placed = shards.drop("n_tokens").join(starts, ["part", "shard"])
    return placed.select("start", "doc_ids", "ends", "codes").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """(position, token) for each row of ``positions`` (position); one outside the files gives no row.

    A position meets its shard over a grid of token ranges; the token is then read in place.
    """
    spark = positions.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for at, start, codes in zip(*batch.columns, strict=True):
                tokens.append(Codes(codes.as_buffer())[at.as_py() - start.as_py()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], ["position", "token"])

    starts = shard_starts(spark, path).withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("start") / SHARD_TOKENS), F.floor((F.col("start") + F.col("n_tokens") - 1) / SHARD_TOKENS))))
    asked = positions.select("position").withColumn("cell", F.floor(F.col("position") / SHARD_TOKENS))
    found = asked.join(starts, "cell").where("position >= start and position < start + n_tokens")
    held = spark.read.parquet(path).select("part", "shard", "codes")
    return found.join(held, ["part", "shard"]).select("position", "start", "codes").mapInArrow(
        run, "position bigint, token bigint")
