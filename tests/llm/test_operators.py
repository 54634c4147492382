"""The text operators against plain versions, exact round trips and held-out rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kilocast.llm import chat, common, decontaminate, jaccard, mixing, ppm, queries, spotsigs, substrings, tokens, toxicity, warc
from kilocast.llm.common import Words, blocks, connected
from tools.check import compare, views

SMOKE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, key string"
VOCABULARY = ["the", "of", "and", "to", *(f"w{i}" for i in range(300))]


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Originals, exact and near copies, shared passages, and every odd kind of row."""
    rng = random.Random(7)
    texts = []
    shared = prose(99, 60)
    for i in range(40):
        words = prose(i, rng.randint(1, 160))
        if i % 5 == 0:
            words[len(words) // 2 :] = shared + words[len(words) // 2 :]
        texts.append(" ".join(words))
    for i in range(0, 40, 3):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts += [texts[i], " ".join(words), texts[i].upper() if i % 2 else texts[i] + "\n"]
    texts += ["", None, " \t\n", "one", "One two", "x" * 300, "the " * 400, " ".join(prose(500, 20_000)), "Ñandú é 日本   x"]
    rows = [(i * 3, t, "en", float(i), "k") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[1], None, None, None), (None, "alone with no id at all", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def split(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


# Helpers


def test_word_hashes_agree_with_equality():
    texts = [b"a b  c a b", b"", b"a b c", b" c\ta\nb "]
    words = Words(texts)
    assert [words.data[s:e] for s, e in zip(words.start, words.end)] == [w for t in texts for w in t.split()]
    at, hashes = words.windows(2)
    pairs = [words.data[words.start[i] : words.end[i + 1]] for i in at]
    assert pairs == [b"a b", b"b c", b"c a", b"a b", b"a b", b"b c", b"c a", b"a b"]
    assert len(set(hashes.tolist())) == len(set(pairs)) == 3


def test_components_are_those_of_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# Jaccard join


def plain_components(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        w = split(text, True)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else []))
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    out = []
    for (doc_id, *_), s, c in zip(rows, sets, comp):
        ids = [r[0] for r, other in zip(rows, comp) if other == c and r[0] is not None]
        out.append((doc_id, len(s), (min(ids) if ids else None) if s else doc_id))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_are_those_of_all_pairs(docs, n, percent):
    found = [tuple(r)[:3] for r in jaccard.components(docs, n, percent).collect()]
    assert Counter(found) == Counter(plain_components(corpus(), n, percent))


def test_linked_sets_meet_in_their_prefixes():
    rng = np.random.default_rng(5)
    frequent = common.IdFilter(1 << 10, rng.integers(0, 2**63, 16, dtype=np.uint64))
    for size in [1, 2, 5, 9, 10, 11, 17, 18, 30, 70, 111, 300, 1000]:
        for percent in (80, 90):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                low = -(-percent * len(a) // 100)
                b = np.unique(np.concatenate([rng.permutation(a)[:low], rng.integers(0, 2**63, len(a) - low, dtype=np.uint64)]))
                for c in (b, np.sort(rng.permutation(a)[:low])):
                    if jaccard._linked(a, c, percent):
                        first, second = (jaccard.prefix(x, frequent, percent) for x in (a, c))
                        assert np.intersect1d(first, second).size


def test_near_but_unlinked_copies_go_through_the_groups(spark):
    """Copies that differ from the first one too much, and from each other little."""
    base = prose(1, 200)
    rows = []
    for i in range(30):
        words = list(base)
        rng = random.Random(i)
        for _ in range(3 + i % 4):
            words[rng.randrange(200)] = f"new{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    found = {tuple(r)[:3] for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert found == set(plain_components(rows, 3, 90))


# Repeated windows


def test_repeated_windows_are_removed_exactly(docs):
    first, expected = {}, []
    rows = [r for r in corpus() if r[0] is not None]
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), doc_id) < doc_id:
                gone[i : i + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        expected.append((doc_id, len(w), sum(gone), b" ".join(kept).decode()))
    expected += [(None, len(split(r[1])), 0, " ".join(r[1].split())) for r in corpus() if r[0] is None]
    assert Counter(map(tuple, substrings.remove_repeated(docs).collect())) == Counter(expected)


# Decontamination


def test_templates_catch_other_values_in_consistent_slots(spark):
    item = "Yesterday Anna bought 12 apples and 7 pears at the old market, then Anna gave 12 apples to her brother."
    other = "Yesterday Clara bought 15 apples and 9 pears at the old market, then Clara gave 15 apples to her brother."
    broken = "Yesterday Clara bought 15 apples and 15 pears at the old market, then Dora gave 15 apples to her brother."
    noise = " ".join(prose(4, 60))
    rows = [
        (1, f"{noise} {item} {noise}"), (2, f"{noise}. {other} {noise}"), (3, item.upper()), (4, noise), (5, None), (6, ""),
        (7, f"{noise}\n{item.replace('old market', 'new market')}"), (8, "Anna 12 Bert 13 " * 30), (None, item), (2, other),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "12 13 14 15")], "item_id long, text string")
    found = [(r.doc_id, r.contaminated, r.item_id) for r in decontaminate.contaminated(docs, items).collect()]
    bad = {1, 2, 3, 7, None}
    assert sorted(found, key=str) == sorted([(i, i in bad, 1 if i in bad else None) for i, _ in rows], key=str)
    one = decontaminate.leaks(spark.createDataFrame([(1, other), (2, broken)], "doc_id long, text string"), items)
    matched = {r.doc_id: r.matched for r in one.collect()}
    assert matched[1] > matched.get(2, 0)


def test_short_items_and_items_of_values_are_found_as_copies(spark):
    short, values = "Which river crosses seven old towns?", "12 + 34 + 56 = 102 and 7 kg 8 kg 9 kg 10 cm 11 cm 13 cm"
    noise = " ".join(prose(6, 40))
    docs = spark.createDataFrame(
        [(1, f"{noise} {short} {noise}"), (2, f"{noise} {values} {noise}"), (3, noise), (4, short),
         (5, f"{noise} 13 + 35 + 57 = 105 and 8 kg 9 kg 7 kg 11 cm 12 cm 10 cm")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, short), (2, values)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1), (2, 2), (4, 1)}


def test_a_passage_of_a_long_item_is_found(spark):
    item = [f"word{i}" for i in range(300)]
    noise = " ".join(prose(6, 40))
    passages = {1: item[100:113], 2: item[100:112], 3: item[40:90], 4: item[10:20] + ["other"] + item[20:30]}
    docs = spark.createDataFrame([(i, f"{noise} {' '.join(w)} {noise}") for i, w in passages.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id: r.matched for r in decontaminate.leaks(docs, items).collect()} == {1: 6, 3: 43}


def test_slots_are_one_to_one_over_all_windows_of_a_copy(spark):
    middle = "while nobody there looked at the long empty road behind"
    item = f"Then Anna bought 12 apples at the old market {middle} before Anna gave 12 apples to her brother."
    good, bad = (item.replace("Anna bought 12", "Clara bought 15").replace("Anna gave 12", x) for x in ("Clara gave 15", "Dora gave 99"))
    docs = spark.createDataFrame([(1, good), (2, bad), (3, item), (4, f"{good}\n{item}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    share = {r.doc_id: r.share for r in decontaminate.leaks(docs, items).collect()}
    assert share[1] == share[3] == share[4] == 1 and share.get(2, 0) < 0.6


def test_a_name_that_opens_a_sentence_is_a_name(spark):
    item = "Anna bought twelve apples at the old market today. Then Anna went home."
    docs = spark.createDataFrame([(1, item.replace("Anna", "Clara"))], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.leaks(docs, items).first().share == 1


# Archives


def test_archives_give_back_every_payload(spark):
    pages = [(1, "http://a/1", "<p>é</p>", 0), (2, None, "<p>é</p>", 0), (3, "x\r\ny", None, 0), (4, "u", "", 0), (None, "n", "<p>é</p>", 0),
             (5, "u", "a\r\n\r\nb" * 1000, 0), (6, "u", "q", 0), (6, "u", "q", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type int")
    index = warc.write_bundles(df, bundle_bytes=300)
    rows = warc.read_bundles(index, with_body=True).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows) == Counter(
        [(1, "revisit", 2, 9), (2, "response", None, 9), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "revisit", 2, 9),
         (5, "response", None, 6000), (6, "response", None, 1), (6, "response", None, 1)]
    )
    bodies = {r.page_id: bytes(r.body) for r in rows if r.record_type == "response"}
    assert bodies == {2: "<p>é</p>".encode(), 4: b"", 5: b"a\r\n\r\nb" * 1000, 6: b"q"}
    assert next(r for r in rows if r.page_id == 1).url == "http://a/1"
    [record] = warc.fetch(index, 5)
    assert warc.parse(record)[1] == bodies[5]
    assert index.select("bundle").distinct().count() > 1


# Token files


def test_wavelet_matrix_answers_like_a_list():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 50_000, 3000), rng.integers(0, 5, 1500), np.zeros(7, int), np.zeros(0, int)):
        m = tokens.WaveletMatrix.build(values)
        assert m.values().tolist() == values.tolist()
        if not len(values):
            continue
        at = rng.integers(0, len(values), 200)
        assert m.access(at).tolist() == values[at].tolist()
        value = int(values[at[0]])
        assert m.count(value) == (values == value).sum() and m.count(10**6) == 0
        assert m.rank(value, int(at[1])) == (values[: at[1]] == value).sum()
        assert m.locate(value).tolist() == np.flatnonzero(values == value).tolist()
        assert m.select(value, 0) == np.flatnonzero(values == value)[0]


def test_token_files_hold_what_the_tokenizer_gives(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    odd = ["It's DON'T 12.5% ñÑ İstanbul ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "x ý é", "naïve​日本語 😀 ²³¼", "\x1c\x85."]
    more = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(odd)], DOCS)
    manifest = common.stored(tokens.write_shards(docs.union(more), tokens.default_tokenizer(), shard_tokens=500))
    assert manifest.count() > 4
    rows = sorted(tokens.read_shards(manifest).collect(), key=lambda r: r.start)
    given = corpus() + [(1000 + i, t) for i, t in enumerate(odd)]
    texts = {}
    for doc_id, text, *_ in given:
        texts.setdefault(doc_id, []).append(text or "")
    start, position = 0, Counter()
    assert [r.doc_id for r in rows] == sorted([g[0] for g in given], key=lambda x: -1 if x is None else x)
    for r in rows:
        coded = [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in texts[r.doc_id]]
        assert r.start == start and (r.n_tokens, r.ids_crc32) in {(len(c), zlib.crc32(c.tobytes())) for c in coded}
        start += r.n_tokens
    word = tokenizer.encode("changed", add_special_tokens=False).ids[0]
    for doc_id, text, *_ in given:
        position[doc_id] += tokenizer.encode(text or "", add_special_tokens=False).ids.count(word)
    found = Counter(r.doc_id for r in tokens.occurrences(manifest, word).collect())
    assert found == +position


# Language model


def test_a_context_gives_all_bytes_a_probability():
    texts = ppm.normal([b"the cat sat on the mat", b"the dog sat", b"a cat", None])
    trie = ppm.Trie(*np.unique(ppm.grams_of(texts, 3)[0], return_counts=True), order=3)
    for context in (b"the", b"cat", b"xyz", b"\n\n\n", b"zat"):
        base = int.from_bytes(context, "big") << 8
        total = (10 ** trie.code(np.arange(base, base + 256, dtype=np.uint64))).sum()
        assert total == pytest.approx(1, abs=1e-9)


def test_scores_match_a_plain_model(docs):
    rows = docs.withColumn("held_out", common.fold("doc_id", 5) == 1)
    found = ppm.score(rows, common.stored(ppm.count(rows.where("not held_out"), 3)), 3).collect()
    words, contexts, fold = Counter(), {}, {}
    for doc_id, text, *_ in corpus():
        fold[doc_id] = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1
        if not fold[doc_id]:
            words.update([*split(text, True), None])
            data = b"\n" * 3 + b" ".join(split(text, True)) + b"\n"
            for i in range(3, len(data)):
                for j in range(4):
                    contexts.setdefault(data[i - j : i], Counter())[data[i]] += 1
    total, kinds = sum(words.values()), len(words)
    expected = []
    for doc_id, text, *_ in corpus():
        toks = [*split(text, True), None]
        base = sum(math.log10((words[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in toks)
        data, score = b"\n" * 3 + b" ".join(split(text, True)) + b"\n", 0.0
        for i in range(3, len(data)):
            out = set()
            for j in range(3, -1, -1):
                left = {s: n for s, n in contexts.get(data[i - j : i], {}).items() if s not in out}
                size = sum(left.values())
                if data[i] in left:
                    score += math.log10((left[data[i]] - 0.5) / size)
                    break
                if left:
                    score += math.log10(0.5 * len(left) / size)
                out |= left.keys()
            else:
                score -= math.log10(256 - len(out))
        expected.append((doc_id, fold[doc_id], len(toks), sum(words[t] > 0 for t in toks), total, round(base, 4), round(score, 4)))
    ours = [(*tuple(r)[:5], round(r.base_score, 4), round(r.score, 4)) for r in found]
    assert Counter(ours) == Counter(expected)


def test_no_gram_is_left_out_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SCORE_BLOCK", 300_000, raising=False)
    draw = random.Random(5)
    rows = [(i, i == 3, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=130_000)) + " \u00fc\u00df") for i in range(20)]
    docs = spark.createDataFrame([*rows, (20, True, rows[0][2][:5000])], "doc_id long, held_out boolean, text string")
    found = {r.doc_id: r.score for r in ppm.score(docs, common.stored(ppm.count(docs.where("not held_out")))).collect()}
    learnt = ppm.grams_of(ppm.normal([t.encode() for _, out, t in rows if not out]))[0]
    grams, counts = np.unique(learnt, return_counts=True)
    assert len(grams) > 1 << 21
    trie = ppm.Trie(grams, counts)
    for i, text in ((0, rows[0][2]), (3, rows[3][2]), (20, rows[0][2][:5000])):
        assert found[i] == pytest.approx(trie.code(ppm.grams_of(ppm.normal([text.encode()]))[0]).sum(), abs=1e-4)


def test_frequent_words_are_at_most_so_many(spark):
    for counts in ([1] * 9 + [5] * 4 + [70_000] * 50, [3] * 50, [2**40 + i for i in range(30)], [], [1, 2, 3]):
        table = spark.createDataFrame([(n,) for n in counts], "n long")
        for most in (0, 3, 10, 54, 100):
            least = ppm._fitting(table, most)
            assert sum(n >= least for n in counts) <= most
    assert ppm._fitting(spark.createDataFrame([(n,) for n in [1, 1, 9, 12]], "n long"), 2) == 9


def test_adaptive_scores_fall_with_repetition():
    once, twice = ppm.adaptive_score(b"some words here"), ppm.adaptive_score(b"some words here some words here")
    assert twice < once < 0 and twice > 1.8 * once


# Toxicity and mixing


def test_toxicity_finds_held_out_rows(spark):
    rows, marks = [], []
    for i in range(600):
        words = prose(i, 30)
        if i % 6 == 0:
            words[5:5] = [random.Random(i).choice(["nasty!", "vilest", "Awful"]), "nasty"]
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(i % 6 == 0), 1))
    rows += [(601, None, "x"), (602, "", "x"), (None, "nasty " * 3, None)]
    marks += [(5, None, None), (None, 1, 0), (9999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    weights = toxicity.train(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert len(scored) == len(rows) and all(0 <= s <= 1 for s in scored.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scored[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held) and scored[601] == scored[602] < 0.5
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_rates_reach_targets_like_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([0.4, 0.4, 0.4], 300), rng.integers(0, 900, 300)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    rates = mixing.fit_rates(table, [6, 3, 1], growth=1.2, min_rate=0.0, max_rate=5.0, steps=25)
    rows = rates.apply(table).collect()
    assert len(rows) == 300 and all(0 <= r.rate <= 5 for r in rows)
    sums = sum(np.array(r.posterior) * r.n_tokens * r.rate for r in rows)
    assert sums / sums.sum() == pytest.approx([0.6, 0.3, 0.1], abs=0.01)
    # Projected gradient in plain numpy, many more steps.
    total, target = n.sum(), np.array([0.6, 0.3, 0.1]) * 1.2 * n.sum()
    r = np.full(300, 1.2)
    for _ in range(3000):
        r = np.clip(r - 0.5 * (p @ (((r * n) @ p - target) / total) + mixing.RIDGE * (r - 1.2)), 0, 5)

    def loss(x):
        return 0.5 * ((((x * n) @ p - target) / total) ** 2).sum() + mixing.RIDGE / 2 * (n / total * (x - 1.2) ** 2).sum()

    by_row = {(a.n_tokens, tuple(a.posterior)): a.rate for a in rows}
    ours = np.array([by_row[int(a), tuple(b.tolist())] for a, b in zip(n, p)])
    assert loss(ours) == pytest.approx(loss(r), abs=2e-4)


def test_posteriors_follow_the_labels(spark):
    rows = [(i, " ".join(prose(i, 30)) + (" alpha" if i % 2 else " beta") * 4, "z") for i in range(300)] + [(900, None, "z"), (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, posterior string")
    marks = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(150)], "doc_id long, domain string")
    weights = mixing.fit_posteriors(docs, marks, ["a", "b"])
    found = {r.doc_id: (r.n_tokens, r.posterior) for r in mixing.posteriors(docs, weights).collect()}
    assert all(found[i][1][i % 2 == 0] > 0.5 for i in range(150, 300)) and found[900][0] == 0
    assert all(sum(post) == pytest.approx(1) for _, post in found.values())


# Fingerprints


def plain_signatures(text):
    """Anchors with the two content words after them, and what follows in threes."""
    found = set()
    for line in re.split("[\\n\\r]+", text.lower().replace("|", " ")):
        words = re.sub(r"[\W_]+", " ", line).split()
        chains, chain = [], ["|"]
        for w in words:
            if w in spotsigs.ANCHORS:
                chains.append(chain)
                chain = [w]
            else:
                chain.append(w)
        for chain in [*chains, chain]:
            if len(chain) > 1:
                found |= {tuple(chain[i : i + 3]) for i in range(0, len(chain), 3)}
    return found


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_fingerprints_of_texts_and_their_edits(docs):
    rows = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs).collect() if r.doc_id is not None}
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    ids = sorted(texts)
    same, sets = {}, {i: plain_signatures(t) for i, t in texts.items()}
    for i, following in zip(ids, ids[1:] + ids[:1]):
        q = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - q] + texts[following][:q]
        assert rows[i].n_chars == len(texts[i])
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(texts[i], rows[i].fingerprint) == rows[i].fingerprint
        assert rows[i].near_edited == pytest.approx(plain_likeness(sets[i], plain_signatures(edited)))
        assert rows[i].near_next == pytest.approx(plain_likeness(sets[i], sets[following]))
        assert int(rows[i].fingerprint.split(":")[0], 16) == len(sets[i])
    long = [rows[i] for i in ids if len(split(texts[i])) > 60 and texts[i] != "the " * 400]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def test_fingerprints_of_odd_rows(spark):
    """Repeated ids: the smallest text of the next id follows; rows without id have no next."""
    rows = [(2, "b two", 1), (2, "a one", 1), (1, "x" * 8, 1), (None, "y" * 8, 1), (None, None, 1), (3, "", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, part int")
    found = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in spotsigs.edited_fingerprints(df).collect())
    edited = [(0, 0, ""), (0, 8, "y" * 6), (1, 8, "x" * 6 + "a "), (2, 5, "a on"), (2, 5, "b tw"), (3, 0, "")]
    assert found == sorted((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in edited)
    assert spotsigs.edited_fingerprints(df.limit(0)).collect() == []


def test_likeness_by_length_partitions(spark):
    sets = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 5, 8, 9, 10, 30, 100)], "a array<long>")
    pairs = sets.crossJoin(sets.withColumnRenamed("a", "b"))
    for row in pairs.select("a", "b", spotsigs.likeness(F.col("a"), F.col("b"), 0.8), spotsigs.likeness(F.col("a"), F.col("b"))).collect():
        exact = plain_likeness(set(row[0]), set(row[1]))
        assert row[3] == pytest.approx(exact) and (row[2] == row[3] if exact >= 0.8 else row[2] in (0, row[3]))


# Chats


def test_calls_are_linked_ordered_and_validated(spark):
    messages = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "needs two"), (1, 2, "tool", "r1"), (1, 3, "assistant", "first"), (1, 4, "tool", "r3"),
         (2, 0, "assistant", "a"), (2, 1, "assistant", "b"), (3, 0, None, None), (None, 0, "user", ""), (3, 0, None, None), (4, 0, "assistant", "x")],
        "conv_id long, turn long, role string, text string",
    )
    calls = spark.createDataFrame(
        [(1, 1, "c1", "sum", '{"b": [1, {"z": 1, "a": "é"}], "a": 2}', ["c3"]), (1, 3, "c3", "sum", '{"a": "x", "c": 1}', []),
         (2, 0, "p", "sum", '{"a": 1}', ["q"]), (2, 1, "q", "sum", "not json", ["p", "lost"]), (4, 0, None, "other", None, None)],
        "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame([("c1", 2, "r1"), ("c3", 4, "r3"), ("c3", 9, "late"), (None, 1, "x")], "call_id string, turn long, content string")
    schemas = spark.createDataFrame([("sum", "a", "integer", True), ("sum", "b", "array", False)], "tool string, param string, type string, required boolean")
    rows = chat.format_chats(messages, calls, results, schemas).collect()
    assert len(rows) == 11
    first = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.step)
    assert [r.turn for r in first] == [0, 3, 4, 1, 2] and [r.step for r in first] == list(range(5))
    by_id = {r.call_id: r for r in rows if r.call_id}
    assert by_id["c1"].errors == "" and by_id["c1"].linked
    assert json.loads(by_id["c1"].json)["call"] == {
        "arguments": {"a": 2, "b": [1, {"a": "é", "z": 1}]}, "id": "c1", "name": "sum", "result": "r1", "valid": True}
    assert '"arguments":{"a":2,"b":[1,{"a":"é","z":1}]}' in by_id["c1"].json
    assert by_id["c3"].errors == "unknown c; wrong type of a"
    assert "reference cycle" in by_id["p"].errors and not by_id["p"].linked
    assert by_id["q"].errors == "arguments are not an object; reference cycle; unknown reference lost"
    [other] = [r for r in rows if r.conv_id == 4]
    assert other.errors == "unknown tool" and json.loads(other.json)["content"] == "x"


def test_long_chains_behind_a_forward_reference(spark, monkeypatch):
    edges = [(0, 100, 1, True), *[(i, i - 1, 1, False) for i in range(1, 12)]]
    df = spark.createDataFrame(edges, "row long, needs long, conv_id long, forward boolean")
    assert {tuple(r) for r in chat.levels(df).collect()} == {(i, 1, False) for i in range(12)}
    monkeypatch.setattr(chat, "MAX_ROUNDS", 3)
    with pytest.raises(RuntimeError, match="longer than 3"):
        chat.levels(df)


# Every operator on nothing, and the registered queries


def test_empty_tables_give_empty_results(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.components(nothing).count() == 0
    assert substrings.remove_repeated(nothing).count() == 0
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert tokens.read_shards(tokens.write_shards(nothing, tokens.default_tokenizer())).count() == 0
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    _, table, rates = mixing.mix_documents(nothing, labels, mixing.TARGETS, steps=2)
    assert rates.apply(table).count() == 0
    assert spotsigs.edited_fingerprints(nothing).count() == 0
    rows = nothing.withColumn("held_out", F.lit(False))
    assert ppm.score(rows, common.stored(ppm.count(rows))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(pages)).count() == 0


@pytest.mark.parametrize("key", list(queries.oracle_sql()))
def test_queries_match_their_sql(spark, key):
    ours = queries.queries()[key](spark, SMOKE).toPandas()
    assert compare(ours, views(SMOKE).execute(queries.oracle_sql()[key]).df()) == ""


def test_every_operator_has_a_query():
    assert {k.split("_")[0] for k in queries.queries()} == {f"op{n}" for n in range(1, 11)}


def test_blocks_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [b"aa", b"b" * 50, None, b"cc", b"d" * 9]})
    sizes = [t.column("text").to_pylist() for t in blocks([batch, batch], size=10)]
    assert [x for s in sizes for x in s] == batch.column("text").to_pylist() * 2
    assert all(len(s) == 1 or sum(len(x or b"") for x in s) <= 10 for s in sizes)


def test_counts_leave_the_workers_in_small_batches(spark, monkeypatch):
    """A batch is held whole beside the executor's heap, whatever a task has counted."""
    sizes, made = [], pa.RecordBatch.from_arrays

    class Documents:
        """In the place of a table: runs the function here, on one text after the other."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            batch = made([pa.array([b"one two three", b"two three four five", None, b"six"], pa.binary())], ["text"])
            sizes.extend(b.num_rows for b in run(iter([batch])))
            return spark.createDataFrame([], schema)

    monkeypatch.setattr(ppm, "bytes_of", lambda name: name)
    monkeypatch.setattr(ppm, "ROWS", 5, raising=False)
    ppm.count(Documents())
    assert sum(sizes) > 40 and max(sizes) == 5


def test_kinds_of_words_cost_no_pattern_unless_they_begin_with_a_digit(monkeypatch):
    class Asked:
        def __init__(self, pattern):
            self.pattern, self.words = pattern, []

        def fullmatch(self, word):
            self.words.append(word)
            return self.pattern.fullmatch(word)

    for name in ("NUMBER", "GLUED"):
        monkeypatch.setattr(decontaminate, name, Asked(getattr(decontaminate, name)))
    text = "Say \u212am -5 +7.5, 3kg 12km/h 4th kg KG Km. (Paris) \u00c9cole 'end.' ... \u00bd \u0661 x-1 U.S.A. 1,000!"
    kinds = decontaminate._Kinds()
    plain, num, unit, capital, glue, marks = 0, 1, 2, 3, 4, 8
    wanted = [capital, unit, num, num, glue, plain, plain, unit, unit, unit, capital, capital, plain, marks, plain, plain, plain, plain, num]
    assert [kinds[w.encode()][8] for w in text.split()] == wanted
    assert [w for w in text.split() if kinds[w.encode()][9]] == ["Km.", "'end.'", "...", "U.S.A.", "1,000!"]
    assert all(w[:1].isdigit() for p in (decontaminate.NUMBER, decontaminate.GLUED) for w in p.words)


def test_windows_of_most_places_hash_as_those_of_a_few():
    token = common.mix(np.arange(40, dtype=np.uint64))
    at = np.delete(np.arange(33), 5)
    alone = [decontaminate._hashed(token, 8, 1, np.array([i]))[0] for i in at.tolist()]
    assert decontaminate._hashed(token, 8, 1, at).tolist() == alone


def test_ascii_words_are_cut_without_the_general_pattern(monkeypatch):
    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    texts = ["Plain words, don't WE'LL x_1-2 <b>a</b> 3kg\u00a0 A\x01b \x7f <|endoftext|> 'S 's're", "caf\u00e9 na\u00efve\u00bd \u65e5\u672c \u0130 \u212a"]
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode([t.encode() for t in texts])] == wanted
    monkeypatch.setattr(tokens, "_PIECE", None)
    monkeypatch.setattr(tokens, "_SIMPLE", None)
    other = ["Other words, she's 9mm (THEY'RE) a-b;c"]
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in other]
    assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode([t.encode() for t in other])] == wanted


def test_known_words_are_looked_up_once_a_text():
    class Once(dict):
        def __getitem__(self, key):
            raise AssertionError("looked up again")

    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    texts = [b"one Two, <|x|> \xe6\x97\xa5\xe6\x9c\xac one", b"", b" two  one\n"]
    first = encoder.encode(texts)
    wanted = [encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, np.uint32).tolist() for x in first] == wanted
    encoder.words = Once(encoder.words)
    assert encoder.encode(texts) == first


def test_template_windows_scramble_the_words_once(monkeypatch):
    text = b"Ask Bob about 5 km of road, then ask Bob again how many miles that is today"
    wanted = [x.tolist() for x in decontaminate.windows(text, (8,))]
    lengths, mix = [], decontaminate.mix
    monkeypatch.setattr(decontaminate, "mix", lambda x: lengths.append(len(x)) or mix(x))
    assert [x.tolist() for x in decontaminate.windows(text, (8,))] == wanted
    assert lengths.count(len(wanted[-1])) == 1


def test_stored_tables_leave_no_shuffle_files(spark):
    import glob
    import tempfile
    import time

    def files():
        top = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
        return set(glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data"))

    before = files()
    kept = common.stored(spark.range(100).repartition(3, "id"))
    stop = time.time() + 20
    while files() - before and time.time() < stop:
        time.sleep(0.1)
    assert not files() - before and kept.count() == 100


def test_sets_ask_only_groups_with_one_of_about_their_size(spark, monkeypatch):
    """Two passages that begin alike and are shared by a short and long texts."""
    words = [f"s{i}" for i in range(40)]
    texts = [words, [*words, "x"], [*words, *(f"l{i}" for i in range(60))], [*words, *(f"l{i}" for i in range(60)), "y"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "connected", lambda edges: common.connected(edges.where("false")))
    asked, plain = [], jaccard.open_groups

    def spy(candidates, groups, *rest):
        asked.append(candidates.count())
        return plain(candidates, groups, *rest)

    monkeypatch.setattr(jaccard, "open_groups", spy)
    monkeypatch.setattr(jaccard, "prefix", lambda tokens, *_: tokens)
    monkeypatch.setattr(jaccard, "GROUP", 1)
    jaccard.components(docs, shingle=3, percent=90).collect()
    assert asked[0] <= 2 * 2


def test_words_of_a_block_are_those_of_its_texts_one_by_one():
    """Told apart all at once, most of them without the table of odd words."""
    texts = ["Ask Bob about 5 km. Then (Bob) said: 'No!' ... \u00c9cole x.) KG", "", "km\nKm 5\nkm \u00e9t\u00e9.", "A don't U.S.A. 3kg"]
    decontaminate._KINDS.clear()
    each = decontaminate.words_of([t.encode() for t in texts])
    assert set(decontaminate._KINDS) == {w.encode() for t in texts for w in t.split() if w[0].isdigit() or not w.isascii()}
    kinds = decontaminate._Kinds()
    for text, (hashes, found, opens) in zip(texts, each):
        known = [kinds[w.encode()] for w in text.split()]
        assert found.tolist() == [k[8] for k in known]
        assert [h.tobytes() for h, k in zip(hashes, known) if k[8] < 8] == [k[:8] for k in known if k[8] < 8]
        ends = [True, *(bool(k[9]) for k in known[:-1])][: len(known)]
        lines = [not i for line in text.split("\n") for i in range(len(line.split()))]
        assert opens.tolist() == [a or b for a, b in zip(ends, lines)]


def test_tasks_give_their_memory_back():
    words, freed = Words([b"a b c"]), []
    kept = words.hashes(words.start, words.end).tolist()
    run = common.tidy(lambda batches: (freed.append(len(common._POWERS.up)) or b for b in batches))
    assert list(run([1, 2])) == [1, 2] and freed[0] > 1 and len(common._POWERS.up) == 1
    words = Words([b"a b c"])
    assert words.hashes(words.start, words.end).tolist() == kept
    tokens.WordEncoder.of(tokens.default_tokenizer(), 9)
    tokens.WordEncoder.forget()
    assert not tokens.WordEncoder._known


def test_groups_are_opened_in_rounds_of_few_texts(spark, monkeypatch):
    rows, plain, asked = [(i, t) for i, t, *_ in corpus()], jaccard.open_groups, []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "GROUP", 1)

    def spy(candidates, *rest):
        asked.append(candidates.count())
        return plain(candidates, *rest)

    monkeypatch.setattr(jaccard, "open_groups", spy)
    wanted = {tuple(r) for r in jaccard.components(docs, 2, 60).drop("cluster").collect()}
    whole = sum(asked)
    asked.clear()
    monkeypatch.setattr(jaccard, "TRAVEL", 0.02)
    assert {tuple(r) for r in jaccard.components(docs, 2, 60).drop("cluster").collect()} == wanted
    assert whole and sum(asked) == whole and max(asked) < whole


def test_grams_are_packed_without_loss():
    rng = np.random.default_rng(4)
    keys = common.distinct(rng.integers(0, 1 << 56, 5000, dtype=np.uint64))
    assert len(keys) == len(set(keys.tolist())) and ppm.unpack_sorted(ppm.pack_sorted(keys)).tolist() == keys.tolist()


def test_blocks_are_scored_in_rounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, i % 3 == 0, t) for i, t, *_ in corpus()], "doc_id long, held_out boolean, text string").repartition(6)
    counts, asked, plain = common.stored(ppm.count(docs.where("not held_out"))), [], ppm.codes

    def spy(packed, *rest):
        asked.append(packed.count())
        return plain(packed, *rest)

    monkeypatch.setattr(ppm, "codes", spy)
    found = ppm.score(docs, counts).collect()
    assert len(asked) > 1 and max(asked) < sum(asked)
    monkeypatch.setattr(ppm, "ROUNDS", 1)
    once = ppm.score(docs, counts).collect()
    key = lambda r: (r.doc_id, r.score)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, once), key=str) and len({key(r) for r in once}) > 40


def test_texts_travel_only_where_parity_bits_leave_a_link_open(spark, monkeypatch):
    """Texts share a passage, so all ask each other; few of them are near."""
    passage, rng = [f"s{i}" for i in range(12)], random.Random(3)
    words = [[*passage, *(f"t{i}-{j}" for j in range(rng.randint(80, 99)))] for i in range(30)]
    words += [[*w[:60], "other", *w[61:]] for w in words[:4]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    opened, unpack = spark.sparkContext.accumulator(0), jaccard._unpack

    def spy(packed, shingle):
        opened.add(len(packed))
        return unpack(packed, shingle)

    monkeypatch.setattr(jaccard, "_unpack", spy)
    monkeypatch.setattr(jaccard, "prefix", lambda tokens, *_: tokens)
    monkeypatch.setattr(jaccard, "GROUP", 1)
    found = {r.doc_id: r.component_id for r in jaccard.components(docs, shingle=3, percent=80).collect()}
    assert found == {i: i % 30 for i in range(34)}
    assert opened.value <= 4 * len(words)


def test_parity_bits_count_no_more_than_the_tokens_that_differ():
    rng = np.random.default_rng(8)
    for size in (1, 63, 64, 65, 200, 1000):
        for cut in (0, size // 9, size):
            both = common.distinct(rng.integers(0, 1 << 63, 2 * size).astype(np.uint64))
            a, b = both[:size], both[cut : 2 * size - cut // 2]
            bits = [np.frombuffer(jaccard.parity(x), np.uint64) for x in (a, b)]
            assert all(64 * len(x) >= len(t) for x, t in zip(bits, (a, b)))
            a_bits, b_bits = (jaccard.folded(x, min(map(len, bits))) for x in bits)
            assert np.bitwise_count(a_bits ^ b_bits).sum() <= len(np.setxor1d(a, b))


def test_words_of_a_block_are_looked_up_once_a_block():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    texts = ["Some words come, come again: again", "", "  again\x0b some Some\u00a0words\n", "\x1c \x85 <|endoftext|> \u65e5", "come"] * 3
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        encoder.words = Counted(encoder.words)
        assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode([t.encode() for t in texts])] == wanted
        assert encoder.words.asked <= len({w for t in texts for w in t.encode().split()} | {b""})
    assert encoder.encode([]) == [] and encoder.encode([b"", b" "]) == [b"", b""]


def test_letters_are_summed_in_little_memory():
    import tracemalloc

    buffer = np.random.default_rng(5).integers(0, 256, 1 << 20).astype(np.uint8)
    up, _ = common._POWERS.get(len(buffer) + 1)
    wanted = np.cumsum(common._LETTERS[buffer] * up[: len(buffer)], dtype=np.uint64)
    tracemalloc.start()
    try:
        sums, _ = common.byte_sums(buffer)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not sums[0] and (sums[1:] == wanted).all() and peak < 1.5 * sums.nbytes
    assert common.byte_sums(buffer[:0])[0].tolist() == [0]
