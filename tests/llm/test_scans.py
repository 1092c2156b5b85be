"""Quality rules, URL filter and secret scan against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import cases
from hypothesis import given, settings, strategies as st

from pairloom.llm import automaton, quality, queries, secrets, urls

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    body = text or ""
    w = BLANK.findall(body)
    lines = [x for x in body.split("\n") if BLANK.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), len(covered),
        len(w) < 20 or 100 * len(covered) > 30 * len(w),
    )


def test_measures(spark):
    got = quality.quality_verdicts(cases.frame(spark)).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter((r[0], *measures(r[1])) for r in cases.rows())
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality_verdicts(cases.empty(spark)).collect() == []
    assert quality.keep_good(cases.empty(spark)).collect() == []


def low(v):
    if v < 64:
        return v
    step = 1 << v.bit_length() - 6
    return v // step * step


def test_thresholds_follow_the_source(spark):
    """What is usual for one source is rejected in another; a small source takes its language's bounds."""
    data = []
    for i in range(150):
        plain = cases.words(i, 40)
        data.append((i, plain, "en", "prose"))
        data.append((1000 + i, plain.replace(" ", " # "), "en", "code"))
    data += [(5000, cases.words(1, 40).replace(" ", " # "), "en", "prose"), (5001, cases.words(7, 40), "en", "rare"), (5002, cases.words(7, 40), None, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert not kept.pop(5000) and all(kept.values())
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and left.count() == len(data) - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=60))
def test_sketch_quantiles_are_within_a_thirty_second(values):
    ordered = sorted(values)
    for share in (25, 75):
        true = ordered[-(-len(values) * share // 100) - 1]
        assert low(true) <= true <= low(true) * 33 / 32 + 1


def test_sketch_equals_plain_quantiles(spark):
    docs = spark.createDataFrame([(i, cases.words(i, 20 + i % 90) + " #" * (i % 11), "en", f"s{i % 2}") for i in range(300)], "doc_id bigint, text string, lang string, source string")
    measured = quality.materialise(quality.with_measures(docs))
    rows = [r for r in measured.collect() if not r.base_failed]
    bounds = {(r.lang, r.source): r.bounds for r in quality.thresholds(measured).collect()}
    for source in ("s0", "s1"):
        for fence in quality.FENCES:
            v = sorted(low(1000 * r[fence.count] // r.n_words) for r in rows if r.source == source)
            q25, q75 = (v[-(-len(v) * share // 100) - 1] for share in (25, 75))
            reach = fence.spread * (q75 - q25) + fence.margin
            assert bounds["en", source][f"{fence.name}_most"] == q75 + reach
            if fence.below:
                assert bounds["en", source][f"{fence.name}_least"] == q25 - reach


def test_native_plans(spark):
    for name in ("op1_quality_rules", "op7_url_filter"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PAGES = "page_id bigint, url string, html string, host string, rule string"


def page_rows():
    link = lambda h: f'<p><A HREF = "https://{h}/x">y</a><a href=/local>z</a>'
    return [
        (1, "http://Good.com/fr/1", link("friend.net") * 2), (2, "https://bad.com/de/9", "x"), (3, "http://friend.net/a?b#c", "plain"),
        (4, "http://spam.net/q", link("bad.com")), (5, "ftp://spam2.net", link("spam.net") + '<a href="//friend.net/r">'), (6, None, None), (7, "no scheme", ""),
        (8, "http://a.example.org/en/12", None), (9, "http://a.example.org/es/", ""), (10, "http://xexample.org/es/", ""), (11, "://org/", "<a href='http://spam2.net'>"),
        (12, "http://org", ""), (13, "http://ÄB.Com/de/?x", "é"), (13, "http://ÄB.Com/de/?x", "é"), (14, "http://x.com/de", ""), (15, "a://b://c.com/fr/", ""), (None, "http://org/z", ""),
        (16, "http:///fr/", link("")),
    ]


def expected(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def ranks(edges, seeds, rounds):
    now = dict(seeds)
    for _ in range(rounds):
        new = Counter({h: v * 15 // 100 for h, v in seeds.items()})
        moved = Counter()
        for a, b, n in edges:
            total = sum(m for x, _, m in edges if x == a)
            moved[b] += now.get(a, 0) * (n * urls.PARTS // total) // urls.PARTS
        for h, v in moved.items():
            new[h] += v * 85 // 100
        now = dict(new)
    return now


def test_url_verdicts(spark):
    rows = [(*r, "clash", "clash") for r in page_rows()]
    got = urls.filtered(spark.createDataFrame(rows, PAGES), rounds=6).collect()
    judged = [(r[0], *expected(r[1])) for r in page_rows()]
    pages = Counter(h for _, h, _, _ in judged if h)
    of = lambda v: Counter(h for _, h, _, r in judged if h and r and r.verdict == v)
    trusted, blocked = [h for h, n in of("allow").items() if 2 * n > pages[h]], [h for h, n in of("block").items() if 2 * n > pages[h]]
    edges = Counter()
    for _, url, html in page_rows():
        for target in re.findall(r"(?i)href\s*=\s*[\"']?\s*((?:[a-z]+:)?//[^\"'\s>]*)", html or ""):
            a, b = expected(url)[0], expected(target if not target.startswith("//") else "x:" + target)[0]
            if a and b and a != b:
                edges[a, b] += 1
    forth = [(a, b, n) for (a, b), n in edges.items()]
    trust = ranks(forth, {h: urls.MASS // len(trusted) for h in trusted}, 6)
    distrust = ranks([(b, a, n) for a, b, n in forth], {h: urls.MASS // len(blocked) for h in blocked}, 6)
    want = Counter()
    for page_id, host, path, rule in judged:
        bad = distrust.get(host, 0) > trust.get(host, 0)
        want[page_id, host, path, rule and rule.text, rule.verdict if rule else "block" if bad else "allow"] += 1
    assert Counter(map(tuple, got)) == want
    standing = {r.host: r.verdict for r in got}
    assert standing["spam.net"] == "block" and standing["friend.net"] == "allow"
    assert urls.filtered(spark.createDataFrame([], PAGES)).collect() == []


def brute(text: bytes):
    out = []
    for k, rule in enumerate(secrets.RULES):
        out += [(m.start(), m.end(), k) for m in re.finditer(rule.pattern.encode(), text) if len(m[rule.group]) >= rule.least]
    return sorted(out, key=lambda s: (s[0], s[2]))


PARTS = [
    "password", "passwd", "sEcret", "token", "Api_key", "apikey", "=", ":", " ", "'", '"', "abc", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "ghp_",
    "x", "é", "\n", "-", ".", "==", "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "A" * 40, "f" * 30,
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=8))
def test_automaton_equals_regexes(texts):
    data = [t.encode() for t in texts]
    assert secrets.find(data) == [brute(t) for t in data]


def test_lanes_meet_as_one_pass():
    machine = automaton.compile_rules([r"ab*c", r"[0-9]{5,}"])
    data = ("a" + "b" * 5000 + "c" + "7" * 3000 + "abc").encode()
    import numpy as np

    one = automaton.scan(machine, np.frombuffer(data, np.uint8), lanes=1)
    for lanes in (3, 64, 9000):
        many = automaton.scan(machine, np.frombuffer(data, np.uint8), lanes=lanes)
        assert all((a == b).all() for a, b in zip(one, many))


def test_minimal_automaton_has_no_equal_states():
    machine = automaton.compile_rules(["abc|abd", "x[ab]"])
    seen = {(int(a), *row) for a, row in zip(machine.accept, machine.table.tolist())}
    assert len(seen) == len(machine.table)


def test_secret_columns_and_masking(spark):
    extra = [(900, "é password = 'hunter22' AKIA" + "Z9" * 12 + " " + "0a" * 14, None, None, 1, "c", "c", 7, 1), (901, "ghp_" + "a1B" * 14, None, None, 1, "c", "c", 7, 1)]
    docs = cases.frame(spark, cases.rows() + extra)
    got = secrets.digests(secrets.with_secrets(docs.select("doc_id", "text"))).collect()
    kinds = [r.kind for r in secrets.RULES]
    want = Counter()
    for doc_id, text, *_ in cases.rows() + extra:
        found = [(len(cases.raw(text)[:a].decode()), len(cases.raw(text)[:b].decode()), k) for a, b, k in brute(cases.raw(text))]
        say = lambda s: ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in s)
        counts = Counter(k for *_, k in found)
        want[doc_id, counts[0], counts[1], counts[2], hashlib.sha256(say([s for s in found if s[2] < 3]).encode()).hexdigest(), say(found)] += 1
    assert Counter(map(tuple, got)) == want
    hidden = secrets.masked(docs)
    assert hidden.columns == docs.columns and hidden.count() == len(cases.rows()) + 2
    shown = {r.doc_id: r.text for r in hidden.where("doc_id >= 900").collect()}
    assert shown[900] == "é [assign] [access] [hex]".replace("[assign]", "[assign]'") and shown[901] == "[github]"
    assert hidden.where("text is null").count() == sum(r[1] is None for r in cases.rows())
    assert secrets.with_secrets(cases.empty(spark)).collect() == [] and secrets.masked(cases.empty(spark)).collect() == []


def test_scan_is_linear_in_long_texts():
    """Many matches in one text, a run of megabytes, and ends whose start lies in the match before."""
    rng = random.Random(5)
    words = ["token=abcdef ", "secret=", "token: ", "aaaa", "AKIA" + "Z" * 17, "0a" * 13, '"', " ", "xtoken=bcdefg"]
    for _ in range(200):
        text = "".join(rng.choice(words) for _ in range(rng.randint(1, 12))).encode()
        assert secrets.find([text])[0] == sorted(brute(text), key=lambda s: (s[0], s[2])), text
    began = time.time()
    assert len(secrets.find([b"token=abcdef " * 160_000])[0]) == 160_000
    assert secrets.find([b"secret=token: " + b"a" * 2_000_000])[0] == [(14, 2_000_014, 2)]
    assert time.time() - began < 60
