"""WARC round trips and URL verdicts against plain Python."""

import base64
import gzip
import hashlib
import re

import pytest

from corpusloom.llm.url_filter import LINK, RULES, judge
from corpusloom.llm.warc import parsed, read_warc, write_warc
from corpusloom.session import Scratch
from tests.llm.helpers import LONG, parquet

PAGES = "page_id long, url string, html string, size int, shard int, first int, host string"
ODD = [
    (5, "http://a.com/x", "same"), (3, "http://b.com/", "same"), (9, None, "same"), (3, "http://b.com/", "same"), (1, "http://c.com/\r\nX: y", None), (2, "", ""),
    (None, "http://d.com", "same"), (None, None, "lone"), (7, "https://e.net/fr/q?x#y", "é \U0001f600\r\n\r\nWARC/1.0\r\n"), (8, "HTTP://F.Net/es/", LONG),
]


def odd(spark):
    return spark.createDataFrame([(*r, 1, 1, 1, "h") for r in ODD], PAGES)


@pytest.mark.parametrize("case", ["odd", "table", "empty"])
def test_round_trip(spark, case):
    pages = parquet(spark, "pages") if case == "table" else odd(spark).where("true" if case == "odd" else "false")
    scratch = Scratch(spark)
    manifest = write_warc(spark, pages, scratch.path("w"), scratch, file_bytes=20_000)
    rows, got = pages.collect(), read_warc(spark, scratch.path("w")).collect()
    assert sum(r["records"] for r in manifest.collect()) == len(rows) == len(got)
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            first[r["html"] or ""] = min(r["page_id"], first.get(r["html"] or "", r["page_id"]))
    html = lambda r: r["html"] or ""
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    plain = sorted(str((r["page_id"], len(html(r).encode()), digest(html(r)))) for r in rows)
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"])) for r in got) == plain
    texts = {digest(html(r)): html(r) for r in rows}
    # every record has an id of its own, and every revisit names a response by it
    heads = [fields for r in manifest.collect() for fields, _ in parsed(gzip.open(f"{scratch.path('w').removeprefix('file://')}/{r['file']}"))]
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(rows)
    for h in heads:
        if h["warc-type"] == "revisit":
            led = ids[h["warc-refers-to"]]
            assert led["warc-type"] == "response" and led["warc-payload-digest"] == h["warc-payload-digest"] and led.get("warc-target-uri") == h.get("warc-refers-to-target-uri")
    seen = set()
    for r in got:
        text = texts[r["payload_digest"]]
        if r["record_type"] == "response":
            assert r["html"] == text and r["refers_to"] is None
            assert text not in first or (r["page_id"] == first[text] and text not in seen)
            seen.add(text)
        else:
            assert r["html"] is None and r["refers_to"] == first[text]
    assert set(first) <= seen


def test_reruns_give_the_same_bytes(spark):
    sums = []
    for k in (1, 7):
        scratch = Scratch(spark)
        sums.append(sorted(map(tuple, write_warc(spark, odd(spark).repartition(k), scratch.path("w"), scratch, file_bytes=200).collect())))
    assert sums[0] == sums[1] and len(sums[0]) > 1


def test_small_payloads_are_never_revisited(spark):
    scratch = Scratch(spark)
    write_warc(spark, odd(spark), scratch.path("w"), scratch, revisit_bytes=5)
    assert {r["record_type"] for r in read_warc(spark, scratch.path("w")).collect()} == {"response"}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def spread_of(rows):
    """Verdict per host by personalised PageRank over dictionaries."""
    pages, links = {}, {}
    for url, html in rows:
        host, path = split(url)
        pages.setdefault(host, []).append(rule_of(host, path)[1])
        for dst in {split(x)[0] for x in re.findall(LINK, html or "")}:
            if host and dst and dst != host:
                links[host, dst] = links.get((host, dst), 0) + 1
    score = {}
    for kind, verdict, back in (("trust", "allow", False), ("distrust", "block", True)):
        edges = {}
        for (a, b), n in links.items():
            a, b = (b, a) if back else (a, b)
            edges.setdefault(a, {})[b] = edges.get(a, {}).get(b, 0) + n
        seeds = [h for h, v in pages.items() if h and 2 * v.count(verdict) > len(v)]
        rank = {h: 1 / len(seeds) for h in seeds}
        for _ in range(30):
            new = {}
            for h, x in rank.items():
                for d, n in edges.get(h, {}).items():
                    new[d] = new.get(d, 0) + 0.85 * x * n / sum(edges[h].values())
            home = 1 - sum(new.values())
            for h in seeds:
                new[h] = new.get(h, 0) + home / len(seeds)
            rank = new
        score[kind] = rank
    t, d = score["trust"], score["distrust"]
    return {h: "block" if d.get(h, 0) > t.get(h, 0) and d.get(h, 0) > 1e-6 else "allow" for h in pages}


MADE = [(100, "http://good.com/", '<a href="http://fine.org/x">'), (101, "http://bad.net/es/", ""), (102, "http://spam.org/", "<A HREF='http://bad.net/es/'>"), (103, "http://fine.org/", ""), (104, "x.example.com/en/", None), (105, "s://www.example.com/en/a", ""), (106, "s://b.example.com/en/a", ""), (107, "s://example.com?u://v", "")]


@pytest.mark.parametrize("case", ["odd", "table"])
def test_verdicts(spark, case):
    pages = parquet(spark, "pages") if case == "table" else spark.createDataFrame([(*r, 1, 1, 1, "h") for r in ODD + MADE], PAGES)
    rows = pages.collect()
    spread, want = spread_of([(r["url"], r["html"]) for r in rows]), []
    for r in rows:
        host, path = split(r["url"])
        rule, verdict = rule_of(host, path)
        want.append(str((r["page_id"], host, path, rule, verdict or spread[host])))
    got = judge(spark, pages, Scratch(spark)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    if case == "odd":
        by = {r["page_id"]: r["verdict"] for r in got}
        assert by[102] == "block" and by[103] == "allow" and by[106] == "block" and by[105] == "allow"


def test_copies_of_a_graph_keep_its_verdicts(spark):
    small = [(1, "s://good{}.com/", '<a href="s://fine{}.org/">'), (2, "s://bad{}.net/es/", ""), (3, "s://spam{}.org/", '<a href="s://bad{}.net/es/">'), (4, "s://fine{}.org/", "")]

    def verdicts(copies):
        rows = [(i, url.format(c), html.format(c)) for c in range(copies) for i, url, html in small]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        return {tuple(r) for r in judge(spark, pages, Scratch(spark), floor=0.05).select("page_id", "verdict").collect()}

    one = verdicts(1)
    assert (3, "block") in one and (4, "allow") in one
    assert verdicts(60) == one


def test_empty_pages(spark):
    assert judge(spark, odd(spark).where("false"), Scratch(spark)).count() == 0


def test_shards_follow_the_bytes(spark):
    """Ids at both ends of a long, one far from all others, a third of them null, and one id for all pages."""
    html = lambda k: f"<p>{k}</p>" + "x" * 500
    cases = {
        "ends": [(-(1 << 63), "http://a/", html(1)), ((1 << 63) - 1, "http://b/", html(2)), (-5, "http://c/", html(1))] + [(k, "http://d/", html(k)) for k in range(300)],
        "outlier": [(k, "http://a/", html(k)) for k in range(399)] + [(1 << 60, "http://a/", html(5))],
        "null": [(None if k % 3 == 0 else k, "http://a/", html(k % 50)) for k in range(300)],
        "one": [(7, "http://a/", html(0)) for _ in range(300)],
    }
    for name, rows in cases.items():
        pages, scratch = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), Scratch(spark)
        manifest = write_warc(spark, pages, scratch.path("w"), scratch, shard_bytes=20_000, file_bytes=1 << 30).collect()
        total = sum(len(r[2]) + 500 for r in rows)
        assert max(r["records"] for r in manifest) * 1010 <= 2 * 20_000 + 1010 and len(manifest) >= total // 40_000, name
        got = read_warc(spark, scratch.path("w")).collect()
        assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows), name
        first = {}
        for i, _, t in rows:
            if i is not None:
                first[t] = min(i, first.get(t, i))
        leads = {}
        for r in got:
            if r["record_type"] == "response" and r["page_id"] is not None:
                leads.setdefault(r["payload_digest"], []).append(r["page_id"])
        assert sorted(x for v in leads.values() for x in v) == sorted(first.values()), name
