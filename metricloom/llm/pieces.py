"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut where no piece of the vocabulary could reach across; within a stretch, an agenda holds
the adjacent pairs of symbols that make a piece, best score first and leftmost on ties, and the top
pair is merged until none is left. Texts go through in Arrow batches; the sentencepiece library encodes every stretch
that a batch brings anew and decodes every text, so each row says whether the two agree. Stretches come again and again,
so most of a batch has been merged and checked before.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
# distinct stretches in each half of what a worker remembers, and the longest it remembers
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64
# texts encoded between two checks
SLICE_ROWS = 64


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    """A replacement character for the first invalid byte alone."""
    return "�", error.start + 1


codecs.register_error("metricloom-one-by-one", _one_by_one)


class Vocabulary:
    """What a merge-type model says: pieces, scores, bytes, and where texts may be cut."""

    def __init__(self, definition: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=definition)
        model, self.end_id = self.library, self.library.eos_id()
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.bytes) != 256 or any(model.is_unused(i) for i in range(size)) or model.normalize("  a ") != SPACE * 3 + "a" + SPACE:
            raise ValueError("only merge-type models with byte pieces, white space kept and no normalisation are read")
        self.pieces = {
            model.id_to_piece(i): (i, model.get_score(i)) for i in range(size) if not special[i] and not model.is_byte(i)}
        # what each id stands for; a piece that begins with the space mark loses it at the front of a text
        self.surface = [b""] * size
        for piece, (i, _) in self.pieces.items():
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        self.surface[model.unk_id()] = " ⁇ ".encode()
        self.silent = {i for i in range(size) if special[i] and i != model.unk_id()}
        self.byte_ids = set(self.bytes.values())
        longer = {c for piece in self.pieces if len(piece) > 1 for c in piece}
        # characters that are in no longer piece stand alone; the first keeps stretches apart in a check
        self.lone = [chr(c) for c in range(128) if chr(c) not in longer and c != 0x20]
        if not self.lone:
            raise ValueError("a model without an ASCII character that stands alone isn't read")
        self.stretch = self._stretches(longer)
        # two halves: what was used lately, and what was used before that
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        # stretches that were merged and not checked yet, and those that the library cuts otherwise
        self.unchecked: dict[str, tuple[int, ...]] = {}
        self.wrong: set[str] = set()

    def _stretches(self, longer: set[str]) -> re.Pattern:
        """Stretches that no piece reaches across.

        Three cuts, each made only if the pieces allow it: around an ASCII character that is in no longer piece,
        between letters and signs if no piece has both (a sign that some piece joins to a letter counts as one), and
        before a space mark if no piece has one behind another character.
        """
        if any(SPACE in piece.lstrip(SPACE) for piece in self.pieces):
            return re.compile("(?s:.+)")
        lone = "".join(map(re.escape, self.lone))
        beside = {x for piece in self.pieces for x in zip(piece, piece[1:]) if SPACE not in x}
        letters = {c for pair in beside for c in pair if c.isalpha()}
        while joined := {c for pair in beside if (pair[0] in letters) != (pair[1] in letters) for c in pair} - letters:
            letters |= joined
        joined = "".join(re.escape(c) for c in sorted(letters) if not c.isalpha())
        joined_part = f"|[{joined}]" if joined else ""
        # the class of letters, digits aside, without what is no letter in it
        odd = "".join(re.escape(c) for c in sorted(longer) if not c.isalpha() and re.fullmatch(r"[^\W\d_]", c))
        letter = rf"(?:[^\W\d_{lone}{odd}{SPACE}]{joined_part})"
        return re.compile(rf"[{lone}]|{SPACE}*{letter}+|{SPACE}*(?:(?!{letter})[^{lone}{SPACE}])+|{SPACE}+")

    def merged(self, stretch: str) -> list[int]:
        """Ids of a stretch by the agenda of adjacent pairs."""
        pieces = self.pieces
        symbols: list[str] = list(stretch)
        end = len(symbols)
        before, behind = list(range(-1, end - 1)), list(range(1, end + 1))
        # best score first, then the leftmost
        agenda = []
        for at in range(end - 1):
            found = pieces.get(symbols[at] + symbols[at + 1])
            if found is not None:
                agenda.append((-found[1], at, at + 1, symbols[at] + symbols[at + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            # stale if either side was merged since; a symbol merged into another is empty
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue
            symbols[left], symbols[right] = pair, ""
            following = behind[left] = behind[right]
            if following < end:
                before[following] = left
                found = pieces.get(pair + symbols[following])
                if found is not None:
                    heapq.heappush(agenda, (-found[1], left, following, pair + symbols[following]))
            previous = before[left]
            if previous >= 0:
                found = pieces.get(symbols[previous] + pair)
                if found is not None:
                    heapq.heappush(agenda, (-found[1], previous, left, symbols[previous] + pair))
        ids: list[int] = []
        for symbol in symbols:
            found = pieces.get(symbol)
            if found is not None:
                ids.append(found[0])
            elif symbol:
                ids.extend(self.bytes[b] for b in symbol.encode())
        return ids

    def _look(self, stretch: str) -> tuple[tuple[int, ...], str]:
        """A stretch's ids and decimals, from the older half of what is remembered or anew."""
        held = self.older.get(stretch)
        if held is None:
            made = self.unchecked[stretch] = tuple(self.merged(stretch))
            held = made, " ".join(map(str, made))
        if len(stretch) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[stretch] = held
        return held

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of a text without an end id, and the same as decimals joined by blanks."""
        ids: list[int] = []
        names: list[str] = []
        if text:
            for stretch in self.stretch.findall(SPACE + text.replace(" ", SPACE)):
                held = self.known.get(stretch) or self._look(stretch)
                ids += held[0]
                names.append(held[1])
        return ids, " ".join(names)

    def check(self) -> None:
        """Let the library encode what was merged since the last check, all in one text, and keep what differs.

        A character that stands alone keeps each stretch apart from the one before.
        """
        stretches, self.unchecked = self.unchecked, {}
        apart = self.lone[0]
        front, between = list(self.pieces.get(SPACE, ())[:1]), self.merged(apart)
        expected = front + [i for made in stretches.values() for i in (*between, *made)]
        if not stretches or self.library.encode("".join(apart + s for s in stretches)) == expected:
            return
        self.wrong |= {s for s, made in stretches.items() if self.library.encode(apart + s) != [*front, *between, *made]}

    def agrees(self, text: str, ids: list[int], decoded: str) -> bool:
        """Whether the library has the same ids, as far as its view of the stretches says, and decodes them alike."""
        if self.wrong and not self.wrong.isdisjoint(self.stretch.findall(SPACE + text.replace(" ", SPACE))):
            return False
        return self.library.decode(ids) == decoded

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in a row, the first space mark dropped, invalid bytes replaced one by one."""
        surface = self.surface
        parts = [surface[i] for i in ids]
        first = next((n for n, part in enumerate(parts) if part), None)
        if first is not None and ids[first] not in self.byte_ids and ids[first] != self.library.unk_id():
            parts[first] = parts[first].removeprefix(b" ")
        if not self.silent.isdisjoint(ids[:-1]):
            # bytes on either side of a control id are no one character
            runs: list[list[bytes]] = [[]]
            for i, part in zip(ids, parts, strict=True):
                runs.append([]) if i in self.silent else runs[-1].append(part)
            return "".join(b"".join(run).decode(errors="metricloom-one-by-one") for run in runs)
        return b"".join(parts).decode(errors="metricloom-one-by-one")


_VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary(definition: bytes) -> Vocabulary:
    """One vocabulary for each worker, kept between batches."""
    name = hash(definition)
    if name not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[name] = Vocabulary(definition)
    return _VOCABULARIES[name]


def encoded(docs: DataFrame, definition: bytes, add_end: bool = True, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, decoded, n_tokens, ids_sha256, decoded_sha256, agrees) of every row of ``docs`` (doc_id, text).

    ``definition`` holds the bytes of a merge-type model with byte pieces. ``ids`` ends with the end
    id if ``add_end``; ``decoded`` is the text that the ids stand for; the hashes are of the decimal ids joined by
    one blank and of ``decoded``. ``agrees`` is true where the sentencepiece library encodes all stretches of the text
    to the same ids and decodes them to the same text. ``with_ids`` false leaves ``ids`` and ``decoded`` null, where only the hashes are wanted.

    A null text is an empty one and has the end id alone. Rows, also repeated ones and those of null ids, are
    encoded one by one; a text is encoded whole and takes some 30 bytes a character in one task while it is, and one
    stretch without a blank takes time in n log n. An empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(shared.value)
        end = [model.end_id] if add_end else []
        for whole in batches:
            for low in range(0, len(whole), SLICE_ROWS):
                batch = whole.slice(low, SLICE_ROWS)
                held: dict[str, list] = {name: [] for name in ("ids", "decoded", "n", "ids_hash", "text_hash", "agrees")}
                texts = [text or "" for text in batch.column(1).to_pylist()]
                made = [model.encode(text) for text in texts]
                model.check()
                for text, (ids, names) in zip(texts, made, strict=True):
                    ids += end
                    names = " ".join(filter(None, [names, *map(str, end)]))
                    decoded = model.decode(ids)
                    held["ids"].append(ids if with_ids else None)
                    held["decoded"].append(decoded if with_ids else None)
                    held["n"].append(len(ids))
                    held["ids_hash"].append(hashlib.sha256(names.encode()).hexdigest())
                    held["text_hash"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    held["agrees"].append(model.agrees(text, ids, decoded))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(held["ids"], pa.list_(pa.int32())), pa.array(held["decoded"], pa.string()),
                    pa.array(held["n"], pa.int64()), pa.array(held["ids_hash"], pa.string()),
                    pa.array(held["text_hash"], pa.string()), pa.array(held["agrees"], pa.bool_()),
                ], ["doc_id", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>, decoded string, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
        "agrees boolean")
