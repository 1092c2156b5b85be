"""Suffix dedup and WARC archives against brute force."""

import base64
import hashlib
import io
import json
import os
import subprocess
import sys
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.llm import suffix, warc

SCHEMA = "doc_id bigint, text string, block string, share int, kept string"


def plain(texts, length):
    """(bytes, removed, runs, kept) of each text."""
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(t) > 0 and gone[0]))
        out.append((len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def passages():
    """Texts that share passages at all kinds of distances, with repeats inside one text and low entropy."""
    base = [cases.words(i, 70) for i in range(30)]
    common = cases.words(500, 60)
    out = [f"{base[i]} {common if i % 2 else ''} {base[(i * 7) % 30][:260]} {base[i]}" for i in range(12)]
    out += [common[:219], common[1:220], common[:200], common[5:204], "q" * 700, "q" * 230 + "r" + "q" * 199, "ab" * 300, "é" * 250]
    out += [base[20] + c + base[21] for c in "xyz"] + [base[20][30:] + base[22]]
    return out


@pytest.mark.parametrize("hot,block_bytes", [(1 << 16, 1 << 20), (1 << 16, 1500), (3, 1500), (2, 1 << 20)])
def test_removal_equals_brute_force(spark, hot, block_bytes):
    texts = [*passages(), None, "", "x", *cases.texts()]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "clash", 1, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = suffix.without_repeats(docs, hot=hot, block_bytes=block_bytes).collect()
    want = Counter((i if i % 9 else None, *r) for i, r in enumerate(plain([cases.raw(t) for t in texts], 200)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("length,gram", [(20, 8), (9, 9), (30, 16)])
def test_other_lengths(spark, length, gram):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(0, 90, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = suffix.without_repeats(docs, length=length, gram=gram, block_bytes=400).collect()
    want = {i: r for i, r in enumerate(plain([t.encode() for t in texts], length))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_repeated_rows_lose_their_text_and_nothing_gives_nothing(spark):
    text = cases.words(8, 80)
    docs = spark.createDataFrame([(1, text), (1, text), (2, cases.words(9, 80))], "doc_id bigint, text string")
    left = {(r.doc_id, r.n_removed) for r in suffix.without_repeats(docs).collect()}
    assert left == {(1, len(text)), (2, 0)}
    assert suffix.without_repeats(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8), max_size=7))
def test_merge_of_front_coded_runs(lists):
    runs = [sorted(x) for x in lists]
    coded = [(s, suffix.restored(s, r)) for s, r in (suffix.front_coded(x) for x in runs)]
    assert [c[1] for c in coded] == runs
    out = list(suffix.merged(coded))
    ordered = [runs[r][i] for r, i, _ in out]
    assert ordered == sorted(x for run in runs for x in run)
    for (_, _, n), a, b in zip(out[1:], ordered, ordered[1:]):
        assert n == suffix.common(a, b, 0)


def test_merge_never_compares_known_prefixes(monkeypatch):
    """The bytes compared stay below those of the suffixes, although all share long prefixes."""
    compared = 0
    real = suffix.common

    def counted(a, b, known):
        nonlocal compared
        n = real(a, b, known)
        compared += n - known
        return n

    runs = [suffix.front_coded(sorted(b"p" * 150 + f"{(i * 37 + r) % 999:03d}".encode() for i in range(60))) for r in range(8)]
    monkeypatch.setattr(suffix, "common", counted)
    assert len(list(suffix.merged([(s, suffix.restored(s, t)) for s, t in runs]))) == 480
    assert compared < 8 * 150 + 480 * 3 * 4


def test_gram_hashes_depend_on_their_bytes_only():
    data = np.frombuffer(b"abcabcabcabc" * 40, np.uint8)
    for size in (1, 7, 64, 200):
        values = suffix.gram_hashes(data, size)
        assert len(values) == len(data) - size + 1 and len(set(values.tolist())) == 3


def test_long_documents_are_cut_without_loss():
    data = np.frombuffer(cases.words(4, 3000).encode(), np.uint8)
    starts = np.array([0, len(data)])
    whole = suffix.anchors(data, starts, 60, 16)
    import unittest.mock

    with unittest.mock.patch.object(suffix.segments, "__defaults__", (500,)):
        cut = suffix.anchors(data, starts, 60, 16)
    assert all((a == b).all() for a, b in zip(whole, cut))


PAGES = "page_id bigint, url string, html string, path string, digest string"


def page_rows():
    same = "<p>same</p>"
    out = [(1, "http://a/", same), (2, None, same), (3, "http://c/\r\nX: y", "é\r\n\r\n"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n"), (7, "ü", "z" * 300_000)]
    return out + [(2, "http://b/", same), (5, "u", ""), (None, "n", same), (None, None, None), (8, "u", "<b>"), (9, "u", "<b>")]


@pytest.mark.parametrize("least", [0, 4])
def test_archives(spark, least):
    rows = [(*r, "clash", "clash") for r in page_rows()]
    got = warc.archived(spark.createDataFrame(rows, PAGES).repartition(3), least=least).collect()
    bodies = [cases.raw(r[2]) for r in page_rows()]
    best = {}
    for r, b in zip(page_rows(), bodies):
        best[b] = max(best.get(b, -1), -1 if r[0] is None else r[0])
    want, used = Counter(), set()
    for r, b in zip(page_rows(), bodies):
        keep = None if best[b] < 0 else best[b]
        first = r[0] == keep and b not in used
        if first:
            used.add(b)
        kept = first or len(b) < least
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want[r[0], len(b), digest, "response" if kept else "revisit", None if kept else keep] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest)
    assert {r.url for r in got if r.page_id == 3} == {"http://c/%0D%0AX: y"}
    assert warc.archived(spark.createDataFrame([], PAGES)).collect() == []


def test_every_record_is_a_member_at_its_offset(spark):
    pages = spark.createDataFrame([(*r, "c", "c") for r in page_rows()], PAGES).repartition(2)
    written = warc.write_archives(pages)
    index = warc.normalise(written, warc.revisits(written))
    for path in {r.path for r in written.collect()}:
        data = open(path, "rb").read()
        machine = zlib.decompressobj(warc.GZIP)
        machine.decompress(data)
        assert machine.eof and not machine.unused_data
    for path in {r.path for r in index.collect()}:
        data = open(path, "rb").read()
        lines = [json.loads(x) for x in open(path + ".idx")]
        assert [(x["offset"], x["length"]) for x in lines] == sorted((r.offset, r.length) for r in index.where(index.path == path).collect())
        for x in lines:
            assert zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], wbits=warc.GZIP).startswith(b"WARC/1.1\r\n")
        assert sum(x["length"] for x in lines) == len(data)


def test_streams_of_one_and_of_many_members_read_alike():
    bodies = [warc.response(i, f"http://h/{i}", bytes([65 + i]) * 5000) for i in range(9)]
    one = zlib.compressobj(6, wbits=warc.GZIP)
    single = one.compress(b"".join(bodies)) + one.flush()
    many = b"".join((m := zlib.compressobj(6, wbits=warc.GZIP)).compress(b) + m.flush() for b in bodies)
    for data in (single, many):
        assert [r.raw for r in warc.records(io.BytesIO(data))] == bodies
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(zlib.compress(bodies[0][:-9], wbits=warc.GZIP))))


def test_as_many_tasks_as_archives(spark, monkeypatch):
    """Archives are rewritten and read back by a task each, though their list is small."""
    pages = spark.range(0, 400, 1, 20).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id) AS html")
    written = warc.write_archives(pages)
    archives = written.select("path").distinct().count()
    assert archives == 20
    seen = []
    plain = warc.map_arrow
    monkeypatch.setattr(warc, "map_arrow", lambda df, run, schema: seen.append(df) or plain(df, run, schema))
    index = warc.normalise(written, warc.revisits(written))
    assert warc.read_records(index).count() == 400
    todo, runs = seen
    assert todo.rdd.getNumPartitions() == archives and runs.rdd.getNumPartitions() == archives
    assert index.select(F.input_file_name()).distinct().count() > archives // 2


def test_equal_sha1_is_not_enough(spark):
    rows = [("p", 0, 1, "same", "a", 5), ("p", 1, 2, "same", "b", 5), ("q", 0, 3, "same", "a", 5)]
    written = spark.createDataFrame(rows, "path string, seq bigint, page_id bigint, digest string, sha256 string, size bigint")
    assert [(r.path, r.seq, r.keep_id) for r in warc.revisits(written).collect()] == [("p", 0, 3)]


def _peak_of(code):
    """Peak memory in MB of a Python process."""
    run = subprocess.run(
        [sys.executable, "-c", code + "\nimport resource; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"],
        capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)},
    )
    return int(run.stdout.split()[-1])


def test_a_block_of_one_byte_stays_within_a_gigabyte():
    """8 MB of equal bytes: every place is an anchor of a hot gram."""
    code = """
import numpy as np
from types import SimpleNamespace
from pairloom.llm import suffix
data = np.zeros(8 << 20, np.uint8)
starts = np.array([0, len(data)])
places, hashes = suffix.anchors(data, starts, 200, 64)
block = object.__new__(suffix.Block)
block.data, block.starts, block.places, block.hashes, block.length, block.gram, block.shares = data, starts, places, hashes, 200, 64, 16
place, inverse, one, two, often = suffix._digests(block, np.full(len(places), 2, np.uint8))
assert len(place) == len(data) - 199 and len(one) == 1 and often.tolist() == [len(place)] and not inverse.any()
"""
    assert _peak_of(code) < 1024


def test_ranges_are_merged_before_places_are_listed():
    rng = np.random.default_rng(1)
    for _ in range(50):
        first = rng.integers(0, 60, 12)
        stop = first + rng.integers(-2, 9, 12)
        want = sorted({x for a, b in zip(first.tolist(), stop.tolist()) for x in range(a, b)})
        assert suffix.covered_by(first, stop).tolist() == want
