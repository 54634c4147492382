"""Periodic runs against a plain search, and every odd kind of row."""

import random
import zlib

from pyspark.sql import functions as F

from kilocast.llm.common import Words
from kilocast.llm.periods import collapsed, find_runs, periodic_runs, with_cycles


def plain_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        x = 0
        while x < n - p:
            start = x
            while x < n - p and words[x] == words[x + p]:
                x += 1
            if x - start + p >= max(6, 4 * p):
                found.setdefault((start, x - start + p), p)
            x += x == start
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapsed(words):
    gone = {i for s, n, p in plain_runs(words) for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def samples():
    rng = random.Random(1)
    out = []
    for _ in range(600):
        letters = "abcde"[: rng.randint(2, 4)]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            cycle = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            a, b = rng.randint(0, len(words)), rng.randint(0, len(words))
            words = words[:a] + (cycle * rng.randint(3, 9))[: rng.randint(1, 60)] + words[b:]
        out.append(words)
    return out


def test_runs_are_those_of_a_plain_search():
    texts = samples()
    words = Words([" ".join(t).encode() for t in texts])
    found = find_runs(words)
    by_doc = {}
    for doc, *run in zip(*(x.tolist() for x in found)):
        by_doc.setdefault(doc, []).append(tuple(run))
    assert [by_doc.get(i, []) for i in range(len(texts))] == [plain_runs(t) for t in texts]
    assert [t.decode().split() for t in collapsed(words, *found)] == [plain_collapsed(t) for t in texts]
    assert sum(map(len, by_doc.values())) > 300


def test_long_runs_of_one_word_and_of_two_words():
    texts = [b"x " * 5000, b"a b " * 3000 + b"c " + b"a b " * 3000, b"\n".join(b"w%d" % (i % 999) for i in range(6000))]
    doc, start, length, period = find_runs(Words(texts))
    assert list(zip(doc, start, length, period)) == [(0, 0, 5000, 1), (1, 0, 6000, 2), (1, 6001, 6000, 2), (2, 0, 6000, 999)]


def test_odd_rows_have_defined_results(spark):
    rows = [(3, "go " * 6, 1), (3, "go " * 6, 1), (None, "a b " * 4, 2), (5, None, 3), (6, "", 3), (7, " \t\n", 3), (8, "one", 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int")
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()]
    assert sorted(found, key=str) == sorted(
        [
            (3, 6, [(0, 6, 1)], "go"),
            (3, 6, [(0, 6, 1)], "go"),
            (None, 8, [(0, 8, 2)], "a b"),
            (5, 0, [], ""),
            (6, 0, [], ""),
            (7, 0, [], ""),
            (8, 1, [], "one"),
        ],
        key=str,
    )
    assert periodic_runs(docs.limit(0)).collect() == []


def test_cycles_follow_their_rule(spark):
    rng = random.Random(2)
    texts = {i: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 80))) for i in range(300)}
    docs = spark.createDataFrame([*texts.items(), (None, "a  b"), (1000, None)], "doc_id long, text string")
    found = {r.doc_id: r.text for r in with_cycles(docs).collect()}
    edited = 0
    for i, text in texts.items():
        h, words = zlib.crc32(str(i).encode()), text.split()
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text, edited = " ".join(words[j if j < a else a + (j - a) % p] for j in range(n)), edited + 1
        assert found[i] == text
    assert edited > 15 and found[None] == "a  b" and found[1000] is None
    assert with_cycles(docs).where(F.col("doc_id").isNull()).count() == 1
