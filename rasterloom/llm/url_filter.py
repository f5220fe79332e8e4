"""URL filters: host and path rules, and for the rest a path-template tree.

All of it is DataFrame expressions and joins; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.shared import written

#: Words in a host that make its pages bad examples for the labelled purity.
SEED_TERMS = ("casino", "malware", "pills", "porn", "spam", "warez")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` that fits, else nulls.

    ``rules`` are (verdict, "host/path") pairs; a rule fits its host and all
    subdomains if the path starts with the rule's path. The list is a parameter
    of the plan (a chain of conditions), not data.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    *,
    depth: int = 3,
    min_literal: int = 5,
    z: float = 1.96,
    smoothing: float = 4.0,
    prior: float = 0.1,
    reject: float = 0.5,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, template, rule, purity, verdict.

    Labels: pages that a rule blocks and pages of hosts with a seed term are bad
    (1), pages that a rule allows are good (0), others have none.

    Tree, per host and path position (``depth`` of them; the last holds all
    deeper segments too, joined by ``/``): a segment of digits, hex, or with an
    identifier's digits becomes ``*``. A labelled branch merges into ``*`` only if its siblings have labels
    too, and it is seen fewer than ``min_literal`` times below its parent or its
    bad share does not differ from theirs (two-proportion z below ``z``). Branches
    without labels never share a template with labelled ones: below a parent with
    labels, variable ones and those seen fewer than ``min_literal`` times become
    ``?`` (which no path holds), else ``*``; the others stay literal. A template's
    purity is its bad share smoothed towards its host's, and that towards
    ``prior``, with weight ``smoothing``; a purity of ``reject`` or more is the
    verdict block if the template has labels of its own. Without them nothing is
    rejected.

    Null and broken URLs have empty host and path and the empty template;
    repeated rows, null page ids and rows of one host stay as they are; an
    empty table gives no rows; other columns are ignored.

    Counts are combined before each shuffle; the joins back are on (host,
    branch), sort-merge or broadcast as their measured size allows, so AQE can
    split a host that holds most pages.
    """
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    seeded = F.lit(False)
    for term in SEED_TERMS:
        seeded = seeded | F.col("host").contains(term)
    p = p.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    p = p.withColumn("bad", F.when((F.col("said") == "block") | (F.col("said").isNull() & seeded), 1).when(F.col("said") == "allow", 0))
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    p = p.withColumn("segs", segs)
    variable = lambda s: s.rlike(r"^[0-9]+([._-][A-Za-z0-9]*)?$|^[0-9a-fA-F-]{8,}$|[0-9]{3,}")
    p = p.withColumn("segs", F.transform("segs", lambda s: F.when(variable(s), F.lit("*")).otherwise(s)))
    for k in range(depth - 1):
        p = p.withColumn(f"s{k}", F.coalesce(F.get("segs", F.lit(k)), F.lit("")))
    p = p.withColumn(f"s{depth - 1}", F.array_join(F.slice("segs", depth, F.greatest(F.size("segs"), F.lit(1))), "/")).drop("segs")

    # One pre-aggregated table of raw branches carries all that the tree needs.
    keys = ["host", *(f"s{k}" for k in range(depth))]
    raw = p.groupBy(*keys).agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    raw = written(raw, "branches")
    tree = raw
    parent = ["host"]
    for k in range(depth):
        level = tree.groupBy(*parent, f"s{k}").agg(F.sum("n").alias("ln"), F.sum("labelled").alias("ll"), F.sum("bad").alias("lb"))
        above = tree.groupBy(*parent).agg(F.sum("labelled").alias("pl"), F.sum("bad").alias("pb"))
        both = level.join(above, parent)
        rest_l, rest_b = F.col("pl") - F.col("ll"), F.col("pb") - F.col("lb")
        pool = (F.col("pb") + 1) / (F.col("pl") + 2)
        err = F.sqrt(pool * (1 - pool) * (1 / F.col("ll") + 1 / rest_l))
        apart = (F.col("ll") > 0) & (rest_l > 0) & (F.abs(F.col("lb") / F.col("ll") - rest_b / rest_l) >= z * err)
        s = F.col(f"s{k}")
        often = F.col("ln") >= min_literal
        bare = F.when(often & (s != "*"), s).when(F.col("pl") > 0, "?").otherwise("*")
        name = F.when(s == "", s).when(F.col("ll") == 0, bare).when((rest_l == 0) | (often & apart), s).otherwise("*")
        named = both.select(*parent, f"s{k}", name.alias(f"t{k}"))
        tree = written(tree.join(named, [*parent, f"s{k}"]), "tree")  # else each level would plan all before it three times
        parent = [*parent, f"t{k}"]
    template = F.concat(F.col("host"), *(F.concat(F.when(F.col(f"t{k}") == "", "").otherwise("/"), F.col(f"t{k}")) for k in range(depth)))
    tree = tree.withColumn("template", template)
    hosts = raw.groupBy("host").agg(((F.sum("bad") + smoothing * prior) / (F.sum("labelled") + smoothing)).alias("hp"))
    judged = tree.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb")).join(hosts, "host")
    judged = judged.select("host", "template", "tl", ((F.col("tb") + smoothing * F.col("hp")) / (F.col("tl") + smoothing)).alias("purity"))
    branch = tree.select(*keys, "template").join(judged, ["host", "template"]).select(*keys, "template", "tl", "purity")
    out = p.join(branch, keys, "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when((F.col("tl") > 0) & (F.col("purity") >= reject), "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
