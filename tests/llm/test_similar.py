"""Near copies by shingle similarity against brute force."""

import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import cases
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import similar


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_pairs(rows):
    sets = {r[0]: grams(r[1]) for r in rows}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def changed(text, seed, count):
    rng = random.Random(seed)
    w = text.split()
    for at in rng.sample(range(len(w)), count):
        w[at] = f"new{seed}x{at}"
    return " ".join(w)


def data():
    """Texts with copies on both sides of the bound, which share a passage."""
    out = []
    for g in range(12):
        text = cases.words(g, 190) + " " + cases.words(777, 20)
        out += [text, *[changed(text, 100 * g + n, n) for n in (1, 2, 3, 4, 5, 6, 8)]]
    return [(i, t, "en", "s", 1, "c", "c", 1, 1) for i, t in enumerate(out)]


def test_groups_equal_brute_force(spark):
    rows = data()
    stay = components_of(rows)
    assert 20 < len(stay) < len(rows) - 20
    docs = cases.frame(spark, rows)
    for left in (similar.drop_similar(docs), corpus_pipeline.simhash_near_dedup(spark, docs, "")):
        assert left.columns == docs.columns
        assert {r.doc_id for r in left.collect()} == stay


def components_of(rows):
    """The smallest id of each chain of near pairs."""
    root, pairs = {r[0]: r[0] for r in rows}, near_pairs(rows)
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return set(root.values())


def hot_rows(count=120):
    """Unlike texts that share most of their words, among them chains of similar ones, some of which others stand between."""
    passage, out = cases.words(5, 160), []
    for g in range(count):
        own = cases.words(1000 + g, 28)
        out += [passage + " " + own, changed(passage, g, 2) + " " + own, changed(passage, g, 2) + " " + changed(own, g, 3)]
    base = cases.words(9, 100)
    chain = [base]
    for g in range(12):
        chain.append(changed(chain[-1], 7000 + g, 2))
    return [(i, t, "en", "s", 1, "c", "c", 1, 1) for i, t in enumerate(out + chain)]


def test_a_hot_bucket_of_unlike_texts_keeps_its_chains(spark):
    rows = hot_rows(24)
    left = {r.doc_id for r in similar.drop_similar(cases.frame(spark, rows), step=2).collect()}
    assert left == components_of(rows)


def test_compared_pairs_grow_with_the_group_not_its_square(spark, monkeypatch):
    """A hot group of near copies of one text, and as many texts with the same long passage that are not alike."""
    seen = []
    plain = similar._alike
    monkeypatch.setattr(similar, "_alike", lambda pairs, sets: seen.append(pairs.count()) or plain(pairs, sets))
    base = cases.words(3, 200)
    rows = hot_rows(100) + [(5000 + g, changed(base, g, 3), "en", "s", 1, "c", "c", 1, 1) for g in range(300)]
    rows.append((4999, base, "en", "s", 1, "c", "c", 1, 1))
    left = {r.doc_id for r in similar.drop_similar(cases.frame(spark, rows)).collect()}
    assert sum(5000 <= i for i in left) == 0 and 4999 in left
    assert sum(seen) < 4 * len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are absent")
def test_recall_on_the_documents(spark):
    """All near pairs of the documents, found through shared rare shingles, end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL")
    texts = {}
    for i, t in docs.select("doc_id", "text").collect():
        if len(t.split()) >= 20:
            texts[t] = min(i, texts.get(t, i))
    sets = {i: grams(t) for t, i in texts.items()}
    often = Counter(g for s in sets.values() for g in s)
    meets = defaultdict(list)
    for i, s in sets.items():
        for g in sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]:
            meets[g].append(i)
    pairs = {p for l in meets.values() for p in combinations(sorted(l), 2)}
    pairs = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    changing = True
    while changing:
        changing = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changing = True
    left = {r.doc_id for r in similar.drop_similar(docs.where(F.col("doc_id").isin(list(sets)))).select("doc_id").collect()}
    assert len(pairs) > 20 and left == set(root.values())


def test_awkward_rows(spark):
    left = similar.drop_similar(cases.frame(spark)).collect()
    texts = [frozenset(grams(r.text)) for r in left]
    assert len(texts) == len(set(texts)) and {frozenset(grams(r[1])) for r in cases.rows()} >= set(texts)
    assert similar.drop_similar(cases.empty(spark)).collect() == []
