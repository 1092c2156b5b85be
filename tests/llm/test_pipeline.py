"""The pipeline's stages against brute force on the smallest tables."""

import os
import re
from collections import Counter, defaultdict

import cases
import pytest
from test_near_and_tokens import check_packing, pieces, tiktoken_encoding  # noqa: F401
from test_scans import brute, measures
from test_similar import components_of

import corpus_pipeline
from pairloom.llm import secrets

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def test_stages(spark, tiktoken_encoding):  # noqa: F811
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    results = []
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, FOLDER))
        results.append(now)
    assert all(r.columns == columns for r in results[:-1])
    good, single, apart, hidden = ({r.doc_id: r for r in x.collect()} for x in results[:-1])

    base = {i for i, r in rows.items() if not measures(r.text)[-1]}
    assert set(good) <= base and all(good[i] == rows[i] for i in good)
    # What the adaptive rules reject beyond the base rules is full of symbols.
    assert all(measures(rows[i].text)[2] > 10 for i in base - set(good))

    best = {}
    for i, r in good.items():
        best[r.text] = max(i, best.get(r.text, -1))
    assert set(single) == set(best.values())

    ids = sorted(single)
    assert set(apart) == components_of([(i, single[i].text) for i in ids])

    kinds = [r.kind for r in secrets.RULES]
    assert set(hidden) == set(apart)
    for i, r in hidden.items():
        want, at = b"", 0
        text = apart[i].text.encode()
        for a, b, k in brute(text):
            if a >= at:
                want += text[at:a] + f"[{kinds[k]}]".encode()
            at = max(at, b)
        assert r.text.encode() == want + text[at:] and r.n_chars == len(r.text) and not re.search(r"AKIA[A-Z0-9]{16}", r.text)

    wanted = defaultdict(list)
    for i, r in hidden.items():
        wanted[i] += pieces([*tiktoken_encoding.encode_ordinary(r.text), 0])
    check_packing(results[-1].collect(), dict(wanted))


def test_awkward_documents_pass_through_every_stage(spark):
    docs = cases.frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == [c.split()[0] for c in cases.DOCS.split(", ")]
        docs.count()
    corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()
    nothing = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, FOLDER))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = Counter(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).select(columns).collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).select(columns).collect())) == want
