"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest

from pairloom.llm import spelling


def count(rows, slips):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if slips and h % slips == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def wanted(rows, slips=None):
    n, forms, out = count(rows, slips), {}, {}
    links = {w: [v for v in n if near(w, v)] for w in n}
    for w, k in n.items():
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 10 * k else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n[w], len(links[w]), n[forms[w]] if forms[w] else None)
    return out


def data(seed=1):
    rng = random.Random(seed)
    base = ["abcdefgh", "aabbccdd", "straßeéà", "ÉCOLEnormale", "zzzzzzzz", "mississippi", "hellowhere"]
    words = []
    for w in base:
        words += [w] * 400
        for _ in range(40):
            at, c = rng.randrange(len(w)), rng.choice("abcxyzÀéÿ÷")
            v = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words += [v] * rng.choice([1, 2, 3, 30])
            at = rng.randrange(len(v))
            words += [v[:at] + v[at + 1 :]] * rng.choice([1, 2])
    rng.shuffle(words)
    texts = [rng.choice([" ", "1", "\n", "_", "Ā"]).join(words[i : i + 37]) for i in range(0, len(words), 37)]
    return list(enumerate(texts)) + [(None, texts[0]), (None, None), (7, ""), (7, texts[3]), (7, texts[3]), (8, "q" * 5000 + " " + "q" * 4999 + " " + "Q" * 5000 + " " + "q" * 4999)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], "doc_id bigint, text string, word string, n int, key string").repartition(3)


@pytest.mark.parametrize("slips,limit", [(31, spelling.FILTER_BYTES), (3, 128), (None, 64)])
def test_equals_all_pairs(spark, slips, limit):
    rows = data()
    got = spelling.variants(frame(spark, rows), slips=slips, limit=limit).collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(got) == len(found) and found == wanted(rows, slips)
    assert any(f[0] for f in found.values()) and any(f[1] != (f[0] or w) for w, f in found.items())


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = spelling.variants(cases.frame(spark), slips=31).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == wanted(rows, 31)
    assert spelling.variants(cases.empty(spark), slips=31).collect() == []


def test_edits_and_filters():
    words = ["aabbccdd", "abcdefgé"]
    for length, places, codes in spelling._by_length(words):
        made = set()
        for size, row, place, key in spelling.edits(codes):
            made |= set(key.tolist())
        plain = set()
        for w in words:
            plain |= {w[:i] + w[i + 1 :] for i in range(8)}
            plain |= {w[:i] + chr(c) + w[i + 1 :] for i in range(8) for c in spelling.ALPHABET.tolist() if c > ord(w[i])}
        assert made == {int(k) for k in spelling.word_keys(sorted(plain))}
    keys = spelling.word_keys([cases.words(i, 2).replace(" ", "") + "aaaaaaa" for i in range(2000)])
    table = np.zeros((94, 8), np.uint64)
    for k in range(8):
        np.bitwise_or.at(table[:, k], spelling._blocks(keys, 94), spelling._bits(keys, k))
    assert len(spelling.passes(table, keys)) == 2000
    other = spelling._mixed(np.arange(100_000, dtype=np.uint64))
    assert len(spelling.passes(table, other)) < 1000


def test_a_long_word_comes_in_pieces():
    codes = spelling._codes(["ab" * 20_000], 40_000)
    sizes = [len(k) for *_, k in spelling.edits(codes)]
    assert max(sizes) <= spelling.EDITS * 2 and sum(sizes) > 40_000 * 80
