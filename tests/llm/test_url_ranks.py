"""The URL filter's ranks on large hosts and large crawls."""

from pyspark.sql import functions as F

from pairloom.llm import urls

EDGES = "src string, dst string, n bigint"
RANKS = "side int, host string, rank bigint"


def test_a_host_of_many_links_passes_rank_to_each(spark):
    """Single links beside three million others carry trust and distrust."""
    edges = spark.createDataFrame([("hub", "one", 1), ("hub", "rest", 3_000_000), ("two", "hub", 1), ("more", "hub", 3_000_000)], EDGES)
    mass = urls.MASS * urls.PARTS
    start = spark.createDataFrame([(0, "hub", mass), (1, "hub", mass)], RANKS)
    got = {(r.side, r.host): r.rank for r in urls.propagate(start, edges, 1).collect()}
    small, large = mass // 3_000_001 * 85 // 100, mass * 3_000_000 // 3_000_001 * 85 // 100
    assert abs(got[0, "one"] - small) < 2 and abs(got[1, "two"] - small) < 2 and small > 0
    assert abs(got[0, "rest"] - large) < 2 and abs(got[1, "more"] - large) < 2 and got[0, "hub"] == got[1, "hub"] == mass * 15 // 100


def test_verdicts_of_a_copied_graph_are_those_of_one(spark):
    """A blocked host with 200 linking hosts, one of which an allowed host links to."""

    def pages(copy):
        yield f"http://bad{copy}.com/de/", ""
        yield f"http://good{copy}.com/fr/", f'<a href="http://h0.c{copy}.net">'
        for i in range(200):
            yield f"http://h{i}.c{copy}.net/", f'<a href="http://bad{copy}.com/">'
        yield f"http://far.c{copy}.net/", f'<a href="http://h1.c{copy}.net/">'

    def verdicts(copies):
        rows = [(n, *p) for n, p in enumerate(p for c in range(copies) for p in pages(c))]
        got = urls.filtered(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rounds=3).collect()
        return {r.host: r.verdict for r in got}

    one, many = verdicts(1), verdicts(1000)
    assert one["h1.c0.net"] == one["far.c0.net"] == "block" and one["h0.c0.net"] == "allow"
    assert all(many[h.replace("c0.", f"c{c}.").replace("d0.", f"d{c}.")] == v for c in (0, 1, 999) for h, v in one.items())
    assert sum(v == "block" for v in many.values()) == 1000 * sum(v == "block" for v in one.values())


def test_many_links_to_a_blocked_host_are_all_blocked(spark):
    """A host is blocked however many others link to the same blocked host (ranks as propagate() returns them)."""
    edges = spark.range(200_000).select(F.format_string("h%d", "id").alias("src"), F.lit("bad").alias("dst"), F.lit(1).cast("bigint").alias("n"))
    start = spark.createDataFrame([(1, "bad", urls.MASS * urls.PARTS), (0, "good", urls.MASS * urls.PARTS)], RANKS)
    verdicts = urls.host_verdicts(urls.propagate(start, edges, 2)).groupBy("standing").count().collect()
    assert {r.standing: r["count"] for r in verdicts} == {"block": 200_001, "allow": 1}
