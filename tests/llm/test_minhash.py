"""Near duplicates by min-hashes against all pairs, and every odd kind of row."""

import random
from collections import Counter

import numpy as np
import pytest

from kilocast.llm import minhash
from kilocast.llm.common import Words, mix
from tests.llm.test_operators import DOCS, corpus, plain_components


def kept(rows, n, percent):
    return Counter((i, k, c, i == c) for i, k, c in plain_components(rows, n, percent))


@pytest.mark.parametrize(("n", "percent"), [(4, 80), (5, 90)])
def test_components_are_those_of_all_pairs(spark, n, percent):
    docs = spark.createDataFrame(corpus(), DOCS).repartition(3)
    found = [tuple(r) for r in minhash.near_duplicates(docs, n, percent).collect()]
    assert Counter(found) == kept(corpus(), n, percent)


def test_clusters_of_texts_near_the_threshold(spark, monkeypatch):
    """Variants of one text whose mutual likeness lies on both sides of the threshold: stars leave pairs to compare."""
    monkeypatch.setattr(minhash, "SHARE", 8)  # pairs of a centre in a share
    rng = random.Random(6)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(90)]
        for _ in range(22):
            words = list(base)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 97, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = kept(rows, 4, 80)
    assert 8 < len({c for _, _, c, _ in expected}) < 80
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs, 4, 80).collect()) == expected


def test_linked_sets_share_a_table():
    rng = np.random.default_rng(3)
    count, missed, few = minhash.collections_of(80, 1e-6), 0, 0
    least, factors = minhash.least_equal(80, 1e-6), minhash.factors_of(minhash.MARKS, 1)
    for _ in range(400):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 10, dtype=np.uint64)]) for _ in range(2))
        keys = minhash.banded(np.concatenate([a, b]), np.array([0, 90]), 2 * count)
        same = keys[0] == keys[1]
        missed += not (same[:count].any() and same[count:].any())
        marks = [mix(np.array([(s * f).min() for f in factors])).astype(np.uint8) for s in (a, b)]
        few += (marks[0] == marks[1]).sum() < least
    assert (missed, few) == (0, 0) and count == 21 and 0.6 * minhash.MARKS < least < 0.75 * minhash.MARKS


def test_sets_and_their_sizes():
    texts = [b"a b c d e", b"", b"A b C", b" a  b c d\n", b"x x x x x x"]
    hashes, edges = minhash.shingle_sets(texts, 4)
    assert np.diff(edges).tolist() == [2, 0, 1, 1, 1]
    assert all(np.all(np.diff(hashes[a:b].astype(object)) > 0) for a, b in zip(edges, edges[1:]))
    full, keys = minhash.keys_of(hashes, edges)
    assert full.tolist() == [0, 2, 3, 4] and len(set(keys.tolist())) == 4
    assert hashes[edges[2]] == Words([b"a b c"]).windows(3)[1][0]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, "k"), (None, "", "k"), (1, " ", "k"), (2, "one", "k"), (3, "ONE", "k")], "doc_id int, text string, key string")
    found = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, 0, None, True), (None, 0, None, True), (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []
    long = " ".join(f"w{i}" for i in range(30_000))
    pair = spark.createDataFrame([(9, long), (4, long + " end")], "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(pair).collect()} == {(9, 29_996, 4, False), (4, 29_997, 4, True)}


def test_joins_by_key_make_no_row_for_each_table(spark, monkeypatch):
    """Nodes of a large family, in squares within a u and by table, give few rows before tables are spelt out."""
    rng, rows = random.Random(8), []
    for i in range(40):
        words = [f"w{j}" for j in range(90)]
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, made, join = kept(rows, 4, 80), [], type(docs).join

    def counted(self, other, on=None, how=None):
        found = join(self, other, on, how)
        if on == "key" and how is None:
            made.append(found.count())
        return found

    for block in (8, 1):
        monkeypatch.setattr(minhash, "BLOCK", block)
        with monkeypatch.context() as patch:
            patch.setattr(type(docs), "join", counted)
            found = minhash.near_duplicates(docs, 4, 80)
        assert Counter(tuple(r) for r in found.collect()) == expected
    assert made and max(made) <= 21 * len(rows)
