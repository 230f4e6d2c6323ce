import random
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from metricloom.llm import codes
from metricloom.llm.queries import tokenizer_definition
from metricloom.session import scratch_path
from tests.llm.support import documents, odd_rows, prose, rows_of

DEFINITION = tokenizer_definition()
TOKENIZER = Tokenizer.from_str(DEFINITION)


@pytest.mark.parametrize("most", [1, 255, 256, 50_257, 2**32 - 1])
def test_codes_round_trip_and_random_access(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = (rng.random(n) ** 3 * most).astype(np.uint32)
        held = codes.Codes(codes.encode(ids))
        assert len(held) == n and (held.all() == ids).all()
        assert all(held[i] == ids[i] for i in range(0, n, max(1, n // 200)))
        with pytest.raises(IndexError):
            held[n]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(6)
    marks = [" ", "  ", "\n", "\n\n", ".", ". ", ", ", "'s ", " 's", "\t", " ", " é", "ñ ", "漢字", " 12", "3.4", "<|endoftext|>", " <|endoftext|> ", "***", " | ", "\r\n", "\x1c", "don't ", "A", " ", "🙂"]
    encoder = codes.Encoder(DEFINITION)
    for _ in range(400):
        text = "".join(rng.choice([*marks, *prose(rng, 4)]) for _ in range(rng.randint(0, 60)))
        for _ in range(2):
            assert np.frombuffer(encoder(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, text


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(codes, "CACHED_WORDS", 10)
    encoder, rng = codes.Encoder(DEFINITION), random.Random(7)
    for _ in range(30):
        text = " ".join(prose(rng, 12))
        assert np.frombuffer(encoder(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def written(spark, docs, **settings):
    path = scratch_path(spark, "codes-" + uuid.uuid4().hex)
    codes.write_tokens(docs, path, DEFINITION, **settings)
    return path


def want(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 50)))) for i in range(500)]
    mixed = rows[:]
    rng.shuffle(mixed)
    path = written(spark, documents(spark, mixed, extra=True).repartition(5), shard_tokens=700)
    assert rows_of(codes.read_documents(spark, path)) == sorted(want(rows))
    ids = [x for _, t in rows for x in [*TOKENIZER.encode(t, add_special_tokens=False).ids, 0]]
    asked = spark.range(0, len(ids) + 50, 37).withColumnRenamed("id", "position")
    assert dict(rows_of(codes.tokens_at(asked, path))) == {i: ids[i] for i in range(0, len(ids), 37)}


def test_odd_tables(spark):
    rows = odd_rows()
    path = written(spark, documents(spark, rows, extra=True), shard_tokens=100)
    got = codes.read_documents(spark, path).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [None, None, *sorted(r[0] for r in rows if r[0] is not None)]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(by_start, by_start[1:], strict=False))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(w[2:] for w in want([r[:2] for r in rows]))


def test_empty_table(spark):
    path = written(spark, documents(spark, []))
    assert codes.read_documents(spark, path).count() == 0
