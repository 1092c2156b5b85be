"""SimHash, components, BPE and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.llm import bpe, packing, simhash
from pairloom.llm.components import components

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# --- SimHash ------------------------------------------------------------------


def plain_print(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Root of each distinct fingerprint, comparing all pairs."""
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks_cover(radius):
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not flip & m for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
def test_links_connect_what_all_pairs_connect(spark, radius):
    rng = random.Random(5)
    prints = [0, (1 << 64) - 1]
    for _ in range(25):
        start = rng.getrandbits(64)
        for _ in range(12):
            prints.append(start)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                start ^= 1 << b
    rows = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(prints)], "id bigint, fp bigint")
    got = {r.fp: r.component for r in simhash.near_groups(rows, "id", radius).collect()}
    root = plain_groups(prints, radius)
    least = defaultdict(lambda: len(prints))
    for i, p in enumerate(prints):
        least[root[p]] = min(least[root[p]], i)
    assert got == {simhash.signed(p): least[root[p]] for p in prints}


def test_a_ball_of_fingerprints_makes_few_rows(spark):
    """All 2,017 fingerprints within two bits of one: star links, not pairs."""
    ball = [0] + [1 << a for a in range(64)] + [1 << a | 1 << b for a in range(64) for b in range(a)]
    rows = spark.createDataFrame([(simhash.signed(p),) for p in ball[:-64]], "fp bigint")
    assert simhash.links(rows).count() < 70 * len(ball)


def test_near_duplicates(spark):
    got = simhash.near_duplicates(cases.frame(spark)).collect()
    prints = [plain_print(r[1]) for r in cases.rows()]
    root = plain_groups(prints, 2)
    least = {}
    for r, p in zip(cases.rows(), prints):
        if r[0] is not None:
            least[root[p]] = min(r[0], least.get(root[p], r[0]))
    assert Counter(map(tuple, got)) == Counter((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(cases.rows(), prints))
    assert len(set(prints)) > 10 and simhash.near_duplicates(cases.empty(spark)).collect() == []


def test_one_row_of_each_group_stays(spark):
    docs = cases.frame(spark)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    prints = [plain_print(r[1]) for r in cases.rows()]
    root = plain_groups(prints, 2)
    ids = defaultdict(list)
    for r, p in zip(cases.rows(), prints):
        ids[root[p]].append(r[0])
    want = Counter(min((i for i in x if i is not None), default=None) for x in ids.values())
    assert Counter(r.doc_id for r in left.collect()) == want
    assert simhash.drop_near_copies(cases.empty(spark)).collect() == []


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (3001, 3000), (3000, 3001)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    want = {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1100)} | {3001: 3000}
    assert got == want


# --- tokens -------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.rank_table(RANKS))}, special_tokens={})


def test_ids_equal_the_tokenizer_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    units = packing._units(RANKS, PATTERN)
    for text in cases.texts():
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(packing.packed_ids(text or "", units), "<u4").tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9'st\n\t\r\x0b\x1c  é€.,!😀-"), max_size=60))
def test_units_never_change_ids(text):
    units = packing._units(RANKS, PATTERN)
    assert np.frombuffer(packing.packed_ids(text, units), "<u4").tolist() == units.encoding.encode_ordinary(text)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_bpe_round_trip(spark, tiktoken_encoding, block_bytes):
    tokens = bpe.encode(cases.frame(spark), RANKS, PATTERN, block_bytes=block_bytes)
    got = bpe.digests(tokens, RANKS).collect()
    want = Counter()
    for r in cases.rows():
        ids = tiktoken_encoding.encode_ordinary(r[1] or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[r[0], len(ids), digest, hashlib.sha256(cases.raw(r[1])).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want


def test_bpe_of_nothing(spark):
    assert bpe.digests(bpe.encode(cases.empty(spark), RANKS, PATTERN), RANKS).collect() == []


def test_unknown_ids_are_an_error(spark):
    with pytest.raises(Exception, match="out of bounds|Index"):
        bpe.decode(spark.createDataFrame([([50256],)], "ids array<int>"), RANKS).collect()


# --- packing ------------------------------------------------------------------


def best_fit_decreasing(lengths, capacity):
    import bisect

    gaps, count = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        if k < len(gaps):
            gap = gaps.pop(k) - n
        else:
            count, gap = count + 1, capacity - n
        bisect.insort(gaps, gap)
    return count


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 99), st.integers(1, 40), max_size=40), st.integers(1, 60), st.integers(1, 40))
def test_plans_fill_every_place_once(counts, groups, small):
    large = {k: n for k, n in counts.items() if k > small}
    plan = packing.plan_large(large, 100, groups)
    lengths = np.array([k for k in sorted(large, reverse=True) for _ in range(large[k])], np.int64)
    used = Counter()
    if len(lengths):
        place = plan.place(np.arange(len(lengths)))
        assert place.min() >= 0 and place.max() < plan.sequences
        for p, n in zip(place.tolist(), lengths.tolist()):
            used[p] += n
        assert len(used) == plan.sequences
    assert all(v <= 100 for v in used.values())
    gaps = Counter(100 - v for v in used.values() if v < 100)
    small_counts = {k: n for k, n in counts.items() if k <= small}
    plan = packing.plan_small(small_counts, gaps, 100)
    filled = Counter()
    for k, n in small_counts.items():
        slack, gap = plan.place(np.full(n, k, np.int64), np.arange(n, dtype=np.int64))
        for s, g in zip(slack.tolist(), gap.tolist()):
            assert 0 <= g < (gaps[s] if s >= 0 else plan.new)
            filled[s, g] += k
    assert all(v <= (s if s >= 0 else 100) for (s, _), v in filled.items())


def check_packing(rows, pieces_of, capacity=2048):
    got = defaultdict(list)
    homes = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        homes[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == pieces_of
    for inside in homes.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(homes)


def pieces(ids, capacity=2048):
    first = len(ids) % capacity or capacity
    ends = list(range(first, len(ids) + 1, capacity))
    starts = [0, *ends[:-1]]
    return [(n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(starts, ends))]


def test_packing(spark, tiktoken_encoding):
    got = packing.packed(cases.frame(spark), RANKS, PATTERN).collect()
    want = defaultdict(list)
    for r in cases.rows():
        want[r[0]] += pieces([*tiktoken_encoding.encode_ordinary(r[1] or ""), 0])
    count = check_packing(got, {k: sorted(v) for k, v in want.items()})
    lengths = [p[2] for v in want.values() for p in v]
    assert count <= best_fit_decreasing(lengths, 2048) + 1
    assert packing.packed(cases.empty(spark), RANKS, PATTERN).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_few_sequences(spark, seed):
    rng = random.Random(seed)
    lengths = [min(2048, max(1, int(rng.lognormvariate(6, 1.1)))) for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "id bigint, length bigint")
    got = packing.assign(rows, ["id"])
    used = [r[0] for r in got.groupBy("sequence_id").agg(F.sum("length")).select("sum(length)").collect()]
    assert max(used) <= 2048 and sum(used) == sum(lengths)
    assert len(used) <= best_fit_decreasing(lengths, 2048) * 1.005 + 1


def test_sequences_hold_the_ids(spark, tiktoken_encoding):
    docs = cases.frame(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    parts = packing.materialise(packing.token_pieces(docs, RANKS, PATTERN))
    places = packing.assign(packing.materialise(parts.drop("ids")), ["doc_id", "piece"])
    whole = packing.sequences(parts, places).collect()
    total = sum(len(tiktoken_encoding.encode_ordinary(r.text or "")) + 1 for r in docs.collect())
    assert sum(len(r.ids) // 4 for r in whole) == total
