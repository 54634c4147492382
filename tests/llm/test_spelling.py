"""Spelling variants against all pairs of words, and every odd kind of row."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kilocast.llm import spelling
from kilocast.llm.spelling import PositionIndex, spelling_variants, words_of


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(rows, slip=None):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if slip and doc_id is not None and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    others = {w: sorted((-words[v], v) for v in words if near(w, v)) for w in words}
    form = {w: o[0][1] if o and -o[0][0] >= 2 * words[w] else None for w, o in others.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(others[w]), words.get(form[w])))
    return out


def samples():
    """Words over a few letters, so that most have near ones, some of them many."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(500)]
    texts = [" ".join(words[min(int(rng.expovariate(0.01)), 499)] for _ in range(120)) for _ in range(60)]
    odd = [
        "Straße STRASSE straße's Ünder ünder don't naïve ño",
        "x" * 3000 + " " + "x" * 3001,
        "日本abcde abcde¿abcdé",
        "",
        None,
        " \t\n",
    ]
    rows = [*enumerate(texts + odd * 3), (5, texts[5]), (None, texts[6])]
    return rows


@pytest.mark.parametrize(("letters", "slip"), [(1 << 16, 7), (160, None)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, letters, slip):
    monkeypatch.setattr(spelling, "LETTERS", letters)  # of the shares of a shard
    rows = samples()
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, word string").repartition(3)
    found = [tuple(r) for r in spelling_variants(docs, slip).collect()]
    expected = plain_variants(rows, slip)
    assert len(found) == len(set(found)) and set(found) == expected
    assert len(expected) > 200 and any(r[1] and r[1] != r[2] for r in expected)


def test_words_are_latin_letters():
    assert words_of("Ab-Cé ÀZ÷x ýz 日a") == [x.encode("latin-1") for x in ("ab", "cé", "Àz÷x", "y", "z", "a")]


def test_index_finds_one_edit_and_no_other():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7]))) for _ in range(150)})
    coded = np.array([w.encode() for w in words], dtype="S7").view(np.uint8).reshape(-1, 7)
    index = PositionIndex(coded, 6)
    for longer in (False, True):
        asked = [w for w in words if len(w) == 6 + longer]
        rows = np.array([w.encode() for w in asked], dtype="S7").view(np.uint8).reshape(-1, 7)
        halves = [index.near(rows, longer, front) for front in (True, False)]
        for k, w in enumerate(asked):
            sets = [set(np.flatnonzero(np.unpackbits(h[k].view(np.uint8), bitorder="little")).tolist()) for h in halves]
            assert not sets[0] & sets[1]
            expected = {v for v in words if near(w, v) and min(len(w), len(v)) == 6}
            assert {words[i] for i in sets[0] | sets[1]} == expected
            assert all(words[i][:3] == w[:3] for i in sets[0])


def test_no_documents_have_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(docs, 97).collect() == []
