"""URL filters by a path-template tree, in DataFrame functions only.

Rules judge first: the longest rule whose host is the url's or a parent of it and whose path starts the url's path. The
rest is judged by templates. Paths are split into segments, which make a tree for each host, level by level: segments with a
digit, and those that too many distinct values share a place with, become ``*``, and what lies below them is one subtree.
Siblings whose shares of bad pages do not differ beyond chance are merged, and each node's share of bad pages is smoothed by
that of its parent; a template is rejected when the share at its end reaches ``REJECT``.

Branches and nodes are counted with partial aggregates, so a host that holds a third of all rows adds one row a branch and
task; verdicts join back on (host, nodes), where a hot pair is split by the adaptive join.

Defined cases: a null url and one without ``://`` have an empty host and path and no template of their own but that of the
empty path; unlabelled templates take the host's share, then the table's; ties of rules cannot occur, since rules of one
host have distinct paths of distinct lengths; rows that repeat are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Distinct values in one place from which on they are variable; z below which siblings merge; weight of the prior, in
#: pages; smoothed share of bad pages from which on a template is rejected.
FANOUT, MERGE_Z, PRIOR, REJECT = 64, 1.96, 8.0, 0.5
#: Levels that are generalised one by one; the rest of a longer path is one more.
LEVELS = 12


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?>.*?://)([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?>.*?://)[^/?#]*+(/[^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule's text and verdict; both null where none fits. Length is that of host and path together."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", ""), "/")


def _shape(segment: Column) -> Column:
    """A segment with a digit is variable; its extension stays."""
    ext = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    return F.when(segment.rlike("[0-9]"), F.concat(F.lit("*"), ext)).otherwise(segment)


def templates(pages: DataFrame, scratch: Scratch, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``pages`` (host, path and others) with ``nodes``, the generalised segments of each path.

    A level's literals stay where at most ``fanout`` distinct ones share a place below the same host and generalised
    parent; else they are one wildcard, and what lies below them is one subtree. Each round moves distinct branches only,
    not pages. What lies below ``levels`` segments is one more segment, however long.
    """
    seg = F.transform(_segments(F.col("path")), _shape)
    cut = F.when(F.size(seg) > levels, F.concat(F.slice(seg, 1, levels), F.array(F.array_join(F.slice(seg, F.lit(levels + 1), F.greatest(F.size(seg) - levels, F.lit(1))), "/")))).otherwise(seg)
    shaped = pages.withColumn("__s", cut)
    branches = scratch.keep(shaped.select("host", "__s").distinct().withColumn("nodes", F.array().cast("array<string>")))
    deepest = branches.agg(F.max(F.size("__s")).alias("d")).first()["d"] or 0  # levels + 1 at most
    for i in range(1, deepest + 1):
        here = branches.where(F.size("__s") >= i).select("host", "nodes", F.element_at("__s", i).alias("seg")).distinct()
        wide = here.groupBy("host", "nodes").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > fanout).select("host", "nodes", F.lit("*").alias("any"))
        own = F.when(F.size("__s") >= i, F.concat("nodes", F.array(F.coalesce("any", F.try_element_at("__s", F.lit(i)))))).otherwise(F.col("nodes"))
        new = scratch.keep(branches.join(scratch.keep(wide), ["host", "nodes"], "left").select("host", "__s", own.alias("nodes")))
        scratch.drop(branches)
        branches = new
    return shaped.join(branches, ["host", "__s"]).drop("__s")


def template_text(nodes: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(nodes, "/"))


def _steps(nodes: Column) -> Column:
    """The place and the name of each node on the way to a template; its end is a node of its own, with no name."""
    whole = F.concat(nodes, F.array(F.lit("")))
    return F.transform(F.sequence(F.lit(1), F.size(whole)), lambda i: F.struct(i.alias("depth"), F.slice(whole, F.lit(1), i - 1).alias("parent"), F.element_at(whole, i).alias("name")))


def _merged(children: Column, merge_z: float) -> Column:
    """Siblings in the order of their shares, pooled with those before them as long as chance explains the difference."""
    kind = "array<struct<n:double,k:double,names:array<string>>>"

    def add(groups: Column, x: Column) -> Column:
        last = F.element_at(groups, -1)
        n, k = last["n"] + x["n"], last["k"] + x["k"]
        p = (k + 1) / (n + 2)
        spread = F.sqrt(p * (1 - p) * (1 / F.greatest(last["n"], F.lit(1.0)) + 1 / F.greatest(x["n"], F.lit(1.0))))
        gap = F.abs(last["k"] / F.greatest(last["n"], F.lit(1.0)) - x["k"] / F.greatest(x["n"], F.lit(1.0)))
        alike = (x["n"] == 0) | (last["n"] == 0) | (gap < merge_z * spread)
        joined = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.struct(n.alias("n"), k.alias("k"), F.concat(last["names"], F.array(x["name"])).alias("names"))))
        alone = F.concat(groups, F.array(F.struct(x["n"].alias("n"), x["k"].alias("k"), F.array(x["name"]).alias("names"))))
        return F.when(F.size(groups) == 0, alone).when(alike, joined).otherwise(alone)

    return F.aggregate(F.array_sort(children), F.array().cast(kind), lambda g, x: add(g, x).cast(kind))


def template_verdicts(pages: DataFrame, labelled: DataFrame, scratch: Scratch, merge_z: float = MERGE_Z, prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """(host, nodes, share, learned) from ``pages`` (page_id, host, nodes) and ``labelled`` (page_id, bad 0/1).

    Each node of the tree holds the counts of all pages below it. The children of a node, FANOUT and its end at most, are
    merged where their shares do not differ beyond chance; a template's share is smoothed from the table to the host and
    down its nodes, each by the counts of the branch that it was merged into.
    """
    marks = labelled.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    leaves = scratch.keep(pages.join(marks, "page_id", "left").groupBy("host", "nodes").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k")))
    steps = leaves.select("host", "nodes", "n", "k", F.explode(_steps(F.col("nodes"))).alias("s")).select("host", "nodes", "n", "k", "s.*")
    tree = steps.groupBy("host", "parent", "name").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # Children without labels come first, where they join the branch of the least share.
    child = F.struct(F.when(F.col("n") == 0, -1.0).otherwise(F.col("k") / F.col("n")).alias("share"), "name", "n", "k")
    groups = tree.groupBy("host", "parent").agg(_merged(F.collect_list(child), merge_z).alias("g"))  # at most FANOUT + 1 children
    merged = scratch.keep(groups.select("host", "parent", F.explode("g").alias("g")).select("host", "parent", F.col("g.n").alias("gn"), F.col("g.k").alias("gk"), F.explode("g.names").alias("name")))
    total = leaves.agg(F.sum("n").alias("an"), F.sum("k").alias("ak"))  # one row
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    way = steps.select("host", "nodes", "depth", "parent", "name").join(merged, ["host", "parent", "name"]).groupBy("host", "nodes").agg(F.array_sort(F.collect_list(F.struct("depth", "gn", "gk"))).alias("way"))
    known = way.join(hosts, "host").join(F.broadcast(total))
    base = (F.col("ak") + 1) / (F.col("an") + 2)
    start = (F.col("hk") + prior * base) / (F.col("hn") + prior)
    share = F.aggregate("way", start, lambda p, x: (x["gk"] + prior * p) / (x["gn"] + prior))
    return known.select("host", "nodes", share.alias("share"), F.when(share >= reject, "block").otherwise("allow").alias("learned"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(page_id, host, path, template, share, rule, verdict) of every row of ``pages`` (page_id, url)."""
    scratch = Scratch(pages.sparkSession, "urls")
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    shaped = scratch.keep(templates(cut, scratch, fanout, levels))
    known = scratch.keep(template_verdicts(shaped, labelled, scratch))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = shaped.join(known, ["host", "nodes"])
    return out.select("page_id", "host", "path", template_text(F.col("nodes")).alias("template"), "share", rule.alias("rule"), F.coalesce(verdict, F.col("learned")).alias("verdict"))
