from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.llm.urls import filter_urls, validity

from .data import clashing

EVENTS = "list_name string, kind string, pattern string, verdict string, at timestamp, listed boolean"
CAPTURES = "page_id long, url string, fetched_at timestamp"
START = datetime(2024, 1, 1, tzinfo=UTC)


def day(n):
    return START + timedelta(days=n)


def plain(captures, events):
    """Replays the history of every entry for every capture."""
    out = []
    for page, url, time in captures:
        matches = []
        if url and time and "://" in url:
            rest = url.split("://", 1)[1]
            authority = rest.split("/")[0].split("?")[0].split("#")[0]
            path = rest[len(authority) :].split("?")[0].split("#")[0] or "/"
            host = authority.rsplit("@", 1)[-1].split(":")[0].lower().removesuffix(".")
            for entry in {(e[0] or "", *e[1:4]) for e in events if None not in e[1:]}:
                past = [(e[4], e[5]) for e in events if (e[0] or "", *e[1:4]) == entry and e[4] and e[4] <= time and None not in e[1:]]
                latest = max((t for t, _ in past), default=None)
                listed = any(on for t, on in past if t == latest)
                _, kind, pattern, _ = entry
                fits = {
                    "domain": host == pattern or host.endswith("." + pattern),
                    "prefix": (host + path).startswith(pattern),
                    "url": host + path == pattern,
                }[kind]
                if listed and fits and host:
                    matches.append(entry)

        def rank(e):
            kind = {"domain": 1, "prefix": 2, "url": 3}[e[1]]
            return -kind, -len(e[2].split("." if kind == 1 else "/")) if kind < 3 else 0, e[3] != "block", e[0], e[2]

        best = min(matches, key=rank, default=None)
        out.append((page, len(matches), bool(best) and best[3] == "block", best[0] if best else None, best[2] if best else None))
    return sorted(out, key=repr)


def run(spark, captures, events):
    table = clashing(spark.createDataFrame(captures, CAPTURES), "kind", "row", "time", "bucket")
    got = filter_urls(table, clashing(spark.createDataFrame(events, EVENTS), "valid_to", "bucket"))
    return sorted([(g.page_id, g.n_matches, g.blocked, g.list_name, g.pattern) for g in got.collect()], key=repr)


def test_random_histories(spark):
    rng = random.Random(3)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "x.other.org"]
    paths = ["", "/", "/en", "/en/1.html", "/en/news/2", "/de/?q=/en/"]
    events = []
    for _ in range(300):
        kind = rng.choice(["domain", "prefix", "url"])
        pattern = rng.choice([*hosts, "com", "org"]) if kind == "domain" else rng.choice(hosts) + (rng.choice(["/", "/en/", "/en/news/"]) if kind == "prefix" else rng.choice(["/", "/en", "/en/1.html"]))
        events.append((rng.choice(["x", "y"]), kind, pattern, rng.choice(["block", "allow"]), day(rng.randrange(300)), rng.random() < 0.6))
    captures = [
        (i, rng.choice(["http://", "HTTPS://", "https://user@"]) + rng.choice([*hosts, "A.Example.com:8080"]) + rng.choice(paths), day(rng.randrange(320)) + timedelta(hours=rng.randrange(24)))
        for i in range(400)
    ]
    assert run(spark, captures, events) == plain(captures, events)


def test_boundaries_and_awkward_rows(spark):
    events = [
        ("l", "domain", "bad.com", "block", day(10), True), ("l", "domain", "bad.com", "block", day(20), False), ("l", "domain", "bad.com", "block", day(20), True),
        ("l", "domain", "bad.com", "block", day(30), False), (None, "url", "bad.com/x", "allow", day(0), True),
        ("l", None, "bad.com", "block", day(0), True), ("l", "domain", None, "block", day(0), True), ("l", "domain", "bad.com", None, day(0), True), ("l", "domain", "bad.com", "block", None, True),
        ("l", "domain", "bad.com", "block", day(0), None),
    ]
    captures = [
        (1, "http://bad.com/", day(10)), (2, "http://bad.com/", day(9)), (3, "http://bad.com/", day(20)), (4, "http://bad.com./", day(29)), (5, "http://bad.com/", day(30)),
        (6, "http://bad.com/x?y", day(15)), (7, None, day(15)), (8, "http://bad.com", None), (None, "http://bad.com", day(15)), (9, "not a url", day(15)), (10, "", day(15)),
        (1, "http://bad.com/", day(10)), (11, "http://bad.com/" + "a/" * 5000, day(15)), (12, "http://notbad.com/", day(15)),
    ]
    got = run(spark, captures, events)
    assert got == plain(captures, events)
    assert [g[:3] for g in got if g[0] in (1, 2, 3, 4, 5)] == [(1, 1, True), (1, 1, True), (2, 0, False), (3, 1, True), (4, 1, True), (5, 0, False)]


def test_intervals(spark):
    events = spark.createDataFrame([("l", "domain", "a", "block", day(n), on) for n, on in [(1, True), (3, True), (5, False), (8, True)]], EVENTS)
    got = sorted((r.valid_from, r.valid_to) for r in validity(events).select(F.datediff("valid_from", F.lit("2024-01-01").cast("date")).alias("valid_from"), F.datediff("valid_to", F.lit("2024-01-01").cast("date")).alias("valid_to")).na.fill(-1).collect())
    assert got == [(1, 3), (3, 5), (8, -1)]


def test_empty_tables(spark):
    assert run(spark, [], [("l", "domain", "a", "block", day(0), True)]) == []
    assert run(spark, [(1, "http://a/", day(1))], []) == [(1, 0, False, None, None)]
