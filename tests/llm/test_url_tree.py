"""The path-template tree of the URL filter: what labels reach and what they do not."""

import math
import random
import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from rasterloom.llm import oracles, url_filter

RULES = [("block", "net/es/"), ("block", "net/de/bad/"), ("block", "net/shop/12")]


def verdicts(spark, urls, rules=RULES):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r["page_id"]]: r for r in url_filter.judge_urls(df, rules).collect()}


@pytest.mark.parametrize("n", [1, 3, 40])
def test_pages_outside_a_blocking_rule_stay_allowed(spark, n):
    """A blocked section says nothing about sections without labels, frequent or rare, literal or variable."""
    blocked = [f"http://a.net/es/{k}" for k in range(40)] + [f"http://b.net/es/{k}" for k in range(n)] + [f"http://c.net/de/bad/{k}" for k in range(40)]
    clean = [f"http://{h}.net/{s}/{k}" for h in "abc" for s in ("en", "fr", "de", "777") for k in range(n)] + ["http://a.net", "http://b.net/"]
    got = verdicts(spark, blocked + clean)
    assert {got[u]["verdict"] for u in blocked} == {"block"}
    assert [u for u in clean if got[u]["verdict"] == "block"] == []
    assert {got[u]["template"] for u in blocked} & {got[u]["template"] for u in clean} == set()


def test_labels_of_a_template_reach_its_other_pages(spark):
    """The rule names ids from 12 on; the other ids share their template."""
    got = verdicts(spark, [f"http://a.net/shop/{k}" for k in range(1200, 1240)] + ["http://a.net/shop/7"])
    assert got["http://a.net/shop/7"]["rule"] is None and got["http://a.net/shop/7"]["verdict"] == "block"


def test_segments_below_the_depth_count(spark):
    """Good and bad branches that part in the fifth segment do not share a purity."""
    rules = [("block", "net/a/b/c/d/bad/1"), ("allow", "net/a/b/c/d/good/1")]
    sides = {s: [f"http://x.net/a/b/c/d/{s}/{k}" for k in range(100, 140)] for s in ("bad", "good")}
    got = verdicts(spark, [*sides["bad"], *sides["good"], *(f"http://x.net/a/b/c/d/{s}/7" for s in sides), "http://x.net/a/b/c"], rules)
    assert {got[u]["template"] for u in sides["bad"]} == {"x.net/a/b/c/d/bad/*"}
    assert {got[u]["template"] for u in sides["good"]} == {"x.net/a/b/c/d/good/*"}
    assert (got["http://x.net/a/b/c/d/bad/7"]["verdict"], got["http://x.net/a/b/c/d/good/7"]["verdict"]) == ("block", "allow")


VARIABLE = re.compile(r"^[0-9]+([._-][A-Za-z0-9]*)?$|^[0-9a-fA-F-]{8,}$|[0-9]{3,}")


def by_definition(urls, rules, least=5, z=1.96, smoothing=4.0, prior=0.1, reject=0.5):
    """(host, path, rule, verdict, template, purity) of each URL, host by host and segment by segment."""
    pages = []
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        best = None
        for verdict, rule in rules:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        bad = {"block": 1, "allow": 0}[best[1]] if best else 1 if any(t in host for t in url_filter.SEED_TERMS) else None
        segs = ["*" if VARIABLE.search(s) else s for s in path.split("/") if s]
        segs = [*segs[:2], *(["/".join(segs[2:])] if segs[2:] else [])]
        pages.append({"host": host, "path": path, "rule": best, "bad": bad, "segs": segs + [""] * (3 - len(segs)), "names": []})

    def share(some):
        labels = [p["bad"] for p in some if p["bad"] is not None]
        return len(labels), sum(labels)

    for k in range(3):
        parents = defaultdict(list)
        for p in pages:
            parents[p["host"], tuple(p["names"])].append(p)
        for below in parents.values():
            branches = defaultdict(list)
            for p in below:
                branches[p["segs"][k]].append(p)
            for s, branch in branches.items():
                n, b = share(branch)
                m, c = (x - y for x, y in zip(share(below), (n, b), strict=True))
                if s == "":
                    name = ""
                elif n == 0:
                    name = s if s != "*" and len(branch) >= least else "?" if m else "*"
                elif m == 0:
                    name = s
                else:
                    pool = (b + c + 1) / (n + m + 2)
                    unlike = abs(b / n - c / m) >= z * math.sqrt(pool * (1 - pool) * (1 / n + 1 / m))
                    name = s if unlike and len(branch) >= least else "*"
                for p in branch:
                    p["new"] = name
        for p in pages:
            p["names"].append(p.pop("new"))
    hosts, templates = defaultdict(list), defaultdict(list)
    for p in pages:
        p["template"] = p["host"] + "".join("/" + n for n in p["names"] if n)
        hosts[p["host"]].append(p)
        templates[p["host"], p["template"]].append(p)
    out = []
    for p in pages:
        hn, hb = share(hosts[p["host"]])
        n, b = share(templates[p["host"], p["template"]])
        purity = (b + smoothing * (hb + smoothing * prior) / (hn + smoothing)) / (n + smoothing)
        verdict = p["rule"][1] if p["rule"] else "block" if n and purity >= reject else "allow"
        out.append((p["host"], p["path"], p["rule"] and p["rule"][0], verdict, p["template"], round(purity, 6)))
    return out


def many_urls(n=1500, seed=9):
    """Random hosts and paths of up to seven segments, with rules deep in them, very long and broken URLs."""
    r = random.Random(seed)
    names = ["shop", "news", "12", "2024-01-05", "item7", "id1234", "deadbeef01", "en", "es", "\u00e9t\u00e9", "a.b"]
    urls = [f"http://{r.choice(['a.net', 'b.net', 'x.a.net', 'spam.org', 'C.com', 'www.c.com'])}" + "".join("/" + r.choice(names[: r.choice([4, 11])]) for _ in range(r.choice([0, 1, 1, 2, 2, 3, 5, 7]))) + r.choice(["", "/", "?q=1/2", "#top"]) for _ in range(n)]
    return urls + ["http://a.net/" + "long/" * 5000, "http://a.net/" + "y" * 100_000, None, "", "broken", "http://", "://a.net//es//x", "http://a.net?x/es/", "HTTP://A.NET/es/1"]


DEEP = [("block", "net/es/"), ("block", "a.net/shop/12/"), ("allow", "a.net/shop/news/shop/"), ("block", "x.a.net/shop/news/shop/12"), ("allow", "com/"), ("block", "c.com/news/"), ("allow", "net/en/")]


def test_template_purity_and_verdict_by_definition(spark):
    urls = many_urls()
    want = by_definition(urls, DEEP)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["template"], r["purity"]) for r in url_filter.judge_urls(df, DEEP).collect()}
    assert len({w[4] for w in want}) > 60 and {w[3] for w in want if w[2] is None} == {"allow", "block"}
    for k, w in enumerate(want):
        assert got[k][:5] == w[:5] and abs(got[k][5] - w[5]) < 2e-6, urls[k]


def test_sql_says_the_same(spark):
    urls = many_urls(600, 4)
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})  # noqa: F841
    want = by_definition(urls, DEEP)
    rows = duckdb.sql("SELECT page_id, host, path, rule, verdict, template, purity FROM (" + oracles.urls(DEEP, url_filter.SEED_TERMS) + ") ORDER BY page_id").fetchall()
    for k, *row in rows:
        assert tuple(row[:5]) == want[k][:5] and abs(row[5] - want[k][5]) < 2e-6, urls[k]
    assert len(rows) == len(urls)
