import random
import re

import numpy as np
import pyarrow as pa

from metricloom.llm import segments as S
from tests.llm.support import prose

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return text.encode().lower().decode()


TEXTS = [None, "", " ", "a", "Ab cD", "été 漢字, x-y", "A" * 50, "tail ", " head", "", "x\ny\tz", None]


def test_words_match_patterns():
    for breaks, find in ((S.BLANK, lambda t: [w.decode() for w in BLANK.findall(t.encode())]), (S.PUNCTUATION, PLAIN.findall)):
        found = S.words(pa.array(TEXTS, pa.string()), breaks)
        got = [[found.text(i, i + 1) for i in range(found.first[r], found.first[r + 1])] for r in range(len(TEXTS))]
        assert got == [find(ascii_lower(t or "")) for t in TEXTS]


def test_words_of_a_sliced_batch():
    col = pa.array(TEXTS, pa.string())
    for low, high in ((3, 7), (5, 5), (10, 12)):
        part = S.words(col.slice(low, high - low))
        assert len(part.counts) == high - low
        assert part.counts.tolist() == [len((t or "").split()) for t in TEXTS[low:high]]


def test_slices_cover_all_rows_once():
    col = pa.array(["x" * n for n in (1, 5, 100, 0, 3)] + [None], pa.string())
    runs = list(S.slices(col, 10))
    assert [i for low, high in runs for i in range(low, high)] == list(range(6))
    assert list(S.slices(pa.array([], pa.string()))) == []


def test_equal_words_have_equal_hashes_wherever_they_stand():
    found = S.words(pa.array(["abc zz abc", "q abc", "ab c"], pa.string()))
    h = found.hashes()
    assert h[0] == h[2] == h[4]
    assert len(set(h.tolist())) == 5


def test_winnowing_keeps_a_gram_of_every_window():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=n)) for n in (0, 5, 9, 10, 11, 60, 200)]
    found = S.words(pa.array(texts, pa.string()))
    h = found.hashes()
    at, values = S.minimizers(h, found.row, 6, 5)
    grams, _ = S.grams(h, found.row, 6)
    kept = set(at.tolist())
    assert (np.diff(at) > 0).all() and (grams[at] == values).all()
    for r in range(len(texts)):
        for i in range(found.first[r], found.first[r + 1] - 9):
            window = grams[i:i + 5]
            last = max(j for j in range(5) if window[j] == window.min())
            assert i + last in kept


def test_shared_words_share_a_fingerprint():
    rng = random.Random(4)
    shared = prose(rng, 10)
    for _ in range(20):
        texts = [" ".join(prose(rng, rng.randint(0, 9)) + shared + prose(rng, rng.randint(0, 9))) for _ in range(2)]
        found = S.words(pa.array(texts, pa.string()))
        at, values = S.minimizers(found.hashes(), found.row, 6, 5)
        assert set(values[found.row[at] == 0]) & set(values[found.row[at] == 1])
