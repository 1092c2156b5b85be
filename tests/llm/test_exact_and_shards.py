"""Exact dedup and sharding against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pairloom.llm import exact, sharding

ORDER = lambda x: -1 if x is None else x


def sha(text):
    return hashlib.sha256(cases.raw(text)).hexdigest()


@pytest.mark.parametrize("heavy", [2, 4, 512])
def test_groups_equal_brute_force(spark, heavy):
    got = exact.exact_groups(cases.frame(spark), heavy=heavy).collect()
    groups = defaultdict(list)
    for row in cases.rows():
        groups[sha(row[1])].append(row[0])
    want = Counter()
    for digest, ids in groups.items():
        keep = max(ids, key=ORDER)
        for place, i in enumerate(sorted(ids, key=ORDER, reverse=True)):
            want[(i, keep, len(ids), place == 0, digest)] += 1
    assert Counter(map(tuple, got)) == want


def test_dropping_copies_keeps_columns_and_one_row_each(spark):
    docs = cases.frame(spark)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    kept = left.collect()
    assert sorted(sha(r.text) for r in kept) == sorted({sha(r[1]) for r in cases.rows()})
    assert all(r.doc_id == max((x[0] for x in cases.rows() if sha(x[1]) == sha(r.text)), key=ORDER) for r in kept)


def test_misra_gries_misses_no_frequent_digest(spark):
    data = [("hot" if i % 3 == 0 else f"d{i}",) for i in range(900)]
    rows = spark.createDataFrame(data, "digest string").repartition(5)
    likely, total = exact.frequent(rows, "digest", heavy=4)
    assert total == 900
    found = [r[0] for r in likely.collect()]
    assert "hot" in found and len(found) <= 8


def test_empty_table(spark):
    assert exact.exact_groups(cases.empty(spark)).collect() == []
    assert exact.drop_copies(cases.empty(spark)).collect() == []
    assert sharding.shards(cases.empty(spark)).collect() == []


def minimax(sizes, shards):
    def fits(most):
        used, at = 1, 0
        for s in sizes:
            if s > most:
                return False
            if at + s > most:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(8, 400), min_size=1, max_size=120), st.integers(1, 9), st.integers(0, 5))
def test_capacity_is_that_of_the_full_list(sizes, shards, giant):
    if giant == 0:
        sizes[len(sizes) // 2] += sum(sizes)
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(len(sizes))]
    table = sorted(zip(keys, sizes))

    def sums(digits, prefixes=("",)):
        held = defaultdict(list)
        for key, size in table:
            if key.startswith(tuple(prefixes)):
                held[key[:digits]].append(size)
        return [(p, sum(x), max(x), len(x)) for p, x in held.items()]

    found = sharding.Ranges(sums(1), lambda wide: [r for w in wide for r in sums(len(w[0]) + 1, (w[0],))])
    cuts = found.cuts(shards)
    assert len(cuts) == shards - 1 and cuts == sorted(cuts)
    filled = Counter()
    for key, size in table:
        filled[sum(key >= c for c in cuts)] += size
    assert max(filled.values()) <= minimax([s for _, s in table], shards)


def test_shards(spark):
    got = sharding.shards(cases.frame(spark)).collect()
    want = Counter((r[0], len(cases.raw(r[1])) + 8, zlib.crc32(cases.raw(r[1]))) for r in cases.rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slots, homes, filled = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        homes[(r.size, r.text_crc32)].add(r.shard)
        filled[r.shard] += r.size
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    groups = Counter()
    for r in cases.rows():
        groups[sha(r[1])] += len(cases.raw(r[1])) + 8
    assert max(filled.values()) == minimax([groups[k] for k in sorted(groups)], 24)


def test_one_group_above_the_share_leaves_no_shard_empty():
    items = [(f"{i:04x}", 10, 10, 1) for i in range(200)] + [("8000", 900, 900, 1)]
    found = sharding.Ranges(items, lambda wide: [])
    cuts = found.cuts(10)
    filled = Counter()
    for key, size, *_ in items:
        filled[sum(key >= c for c in cuts)] += size
    assert len(filled) == 10 and max(filled.values()) == 900
    assert np.median(list(filled.values())) >= 200
