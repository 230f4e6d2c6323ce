"""SentencePiece encoding: the agenda against the library, on odd texts, ids and tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from metricloom.llm import pieces
from metricloom.llm.queries import QUERIES, piece_model
from tests.llm.support import documents, odd_rows, prose

SIGNS = "ab  ▁▁\n\t\x00é漢😀𐍈19².,»'\"()—the in ǵ́​\xa0\r;½_"


@pytest.fixture(scope="module")
def model():
    return pieces.Vocabulary(piece_model())


def test_texts_of_all_kinds_match_the_library(model):
    rng = random.Random(5)
    texts = ["", " ", "▁", "  x", "x  ", "\x00", "1234567", "a" * 50, "...!!!", "l'été n'est-ce pas", "\r\n);\r\n"]
    texts += ["".join(rng.choices(SIGNS, k=rng.randint(1, 40))) for _ in range(4000)]
    texts += [" ".join(prose(rng, 20)) for _ in range(50)]
    for text in texts:
        ids, names = model.encode(text)
        assert ids == model.library.encode(text), text
        assert names == " ".join(map(str, ids))
        assert model.decode(ids) == model.library.decode(ids)


def test_stretches_give_what_the_agenda_gives_for_the_whole_text(model):
    rng = random.Random(6)
    for _ in range(500):
        text = pieces.SPACE + "".join(rng.choices(SIGNS, k=30)).replace(" ", pieces.SPACE)
        assert "".join(model.stretch.findall(text)) == text
        assert [i for s in model.stretch.findall(text) for i in model.merged(s)] == model.merged(text)


def test_any_ids_decode_as_in_the_library(model):
    rng = random.Random(7)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(260), 28705, 264, 0, 1, 2]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == model.library.decode(ids), ids


def test_a_small_memory_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    small = pieces.Vocabulary(piece_model())
    text = " ".join(prose(random.Random(8), 200)) * 2
    assert small.encode(text) == model.encode(text)
    assert len(small.known) <= 3 and len(small.older) <= 3


def test_what_the_library_cuts_otherwise_is_told(spark):
    own = pieces.Vocabulary(piece_model())
    own.encode("one two")
    own.check()
    assert not own.wrong and not own.unchecked
    own.unchecked = {"▁one": (1, 2), "▁two": tuple(own.merged("▁two"))}
    own.check()
    assert own.wrong == {"▁one"}
    assert not own.agrees("one two", *_both(own, "one two")) and own.agrees("two", *_both(own, "two"))
    assert not own.agrees("two", own.encode("two")[0], "tw")


def _both(own, text):
    ids = own.encode(text)[0]
    return ids, own.decode(ids)


def test_long_text_without_blanks(model):
    text = "theinga" * 30_000
    assert model.encode(text)[0] == model.library.encode(text)


def test_odd_tables(spark, model):
    rows = odd_rows()
    found = pieces.encoded(documents(spark, rows, extra=True), piece_model()).collect()
    expected = sorted((str(r[0]), *_digest(model, r[1])) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == expected
    assert all(r["agrees"] and len(r["ids"]) == r["n_tokens"] for r in found)
    assert pieces.encoded(documents(spark, []), piece_model()).count() == 0
    bare = pieces.encoded(documents(spark, rows), piece_model(), add_end=False).where("doc_id = 6")
    assert sorted(r["decoded"] for r in bare.collect()) == ["one two", "three"]


def test_the_query_on_whole_tables(spark, model, folder):
    found = QUERIES["op12_pieces"](spark, folder)
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert found.where(~F.col("agrees")).count() == 0
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()) == sorted(
        (r["doc_id"], *_digest(model, r["text"])) for r in texts)


def _digest(model, text):
    ids = model.library.encode(text or "", add_eos=True)
    decoded = model.library.decode(ids)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())
