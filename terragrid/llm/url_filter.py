"""URL filters: rules by host and path, and a path-template tree for all other URLs (DataFrame functions only).

The tree of a host has path segments as branches. From the root on, a node with many even
children makes them one wildcard; a round takes one level of every node that could still have
so many, and is a written table, so neither plan nor work grows with the depth of other paths. Then, at every level,
a branch whose labelled rate agrees with that of the branches beside it is merged with them; a
template is judged by the labels of the largest merged branch that holds it.

Joins on a node have one row for each node on one side: adaptive execution broadcasts that side
where its measured size allows, and else splits the rows of a large host.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, scratch, stored

#: A node's children become one wildcard if there are this many and none has this share of its URLs.
MANY_CHILDREN, TOP_SHARE = 20, 0.2
#: Sibling branches merge while their labelled rates are within so many standard errors.
SIMILAR_Z = 2.0
#: Weight of the host's rate in a template's (and of the overall rate in a host's), and the rate that rejects.
PRIOR, REJECT = 8.0, 0.5


def url_parts(url):
    """(host, path) columns; both are empty without "://"."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_of(host, path, rules: list[tuple[str, str]]):
    """The longest rule that fits (verdict, "host/path"), as (rule, verdict) columns, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _segments(path):
    """Path segments with runs of digits, and hexadecimal names, as wildcards."""
    plain = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{8,}(?:-[0-9a-fA-F]{4,})*", "*"), r"[0-9]+", "*")
    return F.filter(F.split(plain, "/"), lambda s: s != "")


def generalised(urls: DataFrame) -> DataFrame:
    """urls: (host, segs, n), one row each. Returns (host, segs, tpl): the segments with wildcards."""
    spark = urls.sparkSession
    path = scratch(spark, "url-levels")
    now = urls.select("host", "segs", "n", F.array().cast("array<string>").alias("tpl"), F.lit(0).alias("level"))
    for i in itertools.count():
        left = F.slice("segs", F.col("level") + 1, F.greatest(F.size("segs") - F.col("level"), F.lit(0)))
        going = now.where(F.size("segs") > F.col("level"))
        children = going.groupBy("host", "tpl", F.get("segs", F.col("level")).alias("seg")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(left).alias("first"), F.max(left).alias("last"))
        nodes = children.groupBy("host", "tpl").agg(
            ((F.count(F.lit(1)) >= MANY_CHILDREN) & (F.max("n") < TOP_SHARE * F.sum("n"))).alias("wide"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")
        )
        # what all paths of a node begin with is passed at once; nodes of fewer paths than a wildcard needs are done
        differ = F.array_position(F.zip_with("first", "last", lambda x, y: ~x.eqNullSafe(y)), True)
        alike = F.when(differ == 0, F.size("first")).otherwise(differ - 1).cast("int")
        nodes = nodes.where(F.col("rows") >= MANY_CHILDREN).select("host", "tpl", "wide", alike.alias("alike"))
        told = now.join(nodes, ["host", "tpl"], "left")
        open_ = F.col("wide").isNotNull() & (F.size("segs") > F.col("level"))
        step = F.when(~open_, F.size("segs") - F.col("level")).otherwise(F.greatest(F.col("alike"), F.lit(1)))
        more = F.when(open_ & F.col("wide"), F.array(F.lit("*"))).otherwise(F.slice("segs", F.col("level") + 1, F.greatest(step, F.lit(0))))
        told = told.select("host", "segs", "n", F.concat("tpl", more).alias("tpl"), (F.col("level") + step).alias("level"), open_.alias("open"))
        told.write.parquet(f"{path}/round={i}")
        told = spark.read.schema(told.schema).parquet(f"{path}/round={i}")
        now = told.where("open").drop("open")
        if not now.limit(1).count():
            done = urls.select("host", "segs", F.col("segs").alias("tpl"), F.lit(True).alias("open"))
            return spark.read.schema(done.schema).parquet(path).where("not open").select("host", "segs", "tpl")


def branch_purity(leaves: DataFrame) -> DataFrame:
    """leaves: (host, tpl, m, b), one row each: labels and bad ones. Returns (host, tpl, purity).

    A node is a beginning of a template, or a whole one with an end mark; by its digest and its parent's.
    """
    start = F.array(F.md5(F.concat(F.lit("/"), "host").cast("binary")))
    below = lambda acc, s: F.array_append(acc, F.md5(F.concat(F.element_at(acc, -1), s).cast("binary")))
    marks = F.concat(F.transform("tpl", lambda s: F.concat(F.lit("/"), s)), F.array(F.lit("end")))
    paths = leaves.select("host", "tpl", "m", "b", F.aggregate(marks, start, below).alias("path"))
    each = paths.select("host", "tpl", "m", "b", "path", F.posexplode("path").alias("level", "node"))
    sums = each.groupBy("node").agg(F.max(F.get("path", F.col("level") - 1)).alias("parent"), F.sum("m").alias("m"), F.sum("b").alias("b"))
    sums = stored(sums, "url-sums")
    parents = sums.select(F.col("node").alias("parent"), F.col("m").alias("pm"), F.col("b").alias("pb"))
    beside = sums.where("parent is not null").join(parents, "parent")
    # branches whose labels agree with those of the branches beside them
    om, ob = F.col("pm") - F.col("m"), F.col("pb") - F.col("b")
    pooled = (ob + F.col("b") + 1) / (om + F.col("m") + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("m"), F.lit(1)) + 1 / F.greatest(om, F.lit(1))))
    gap = F.abs(F.col("b") / F.greatest(F.col("m"), F.lit(1)) - ob / F.greatest(om, F.lit(1)))
    beside = beside.select("node", "parent", "m", "b", ((F.col("m") == 0) | (om == 0) | (gap <= SIMILAR_Z * error)).alias("merged"))
    apart = beside.where("not merged").select("node")
    pools = beside.where("merged").groupBy(F.col("parent").alias("top")).agg(F.sum("m").alias("mm"), F.sum("b").alias("bb"))
    # the deepest branch of each path that stays apart, or the root: what is merged below it is judged together
    held = each.where("level > 0").join(apart, "node", "left_semi").groupBy("host", "tpl").agg(F.max("level").alias("held"))
    tops = paths.join(held, ["host", "tpl"], "left").select("host", "tpl", "m", "b", F.get("path", F.coalesce("held", F.lit(0))).alias("top"))
    hosts = leaves.groupBy("host").agg(F.sum("m").alias("hm"), F.sum("b").alias("hb"))
    everything = leaves.agg((F.coalesce(F.sum("b"), F.lit(0)) / (F.coalesce(F.sum("m"), F.lit(0)) + 1)).alias("overall"))  # one row
    rated = tops.join(pools, "top", "left").join(hosts, "host").join(F.broadcast(everything))
    rate = (F.col("hb") + PRIOR * F.col("overall")) / (F.col("hm") + PRIOR)
    purity = (F.coalesce("bb", "b") + PRIOR * rate) / (F.coalesce("mm", "m") + PRIOR)
    return rated.select("host", "tpl", purity.alias("purity"))


def template_verdicts(urls: DataFrame) -> DataFrame:
    """urls: (host, segs, n, labelled, bad), one row each. Returns (host, segs, template, purity, verdict)."""
    tree = generalised(urls)
    leaves = stored(tree.join(urls, ["host", "segs"]).groupBy("host", "tpl").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b")), "url-leaves")
    out = tree.join(branch_purity(leaves), ["host", "tpl"])
    template = F.when(F.size("tpl") > 0, F.concat(F.lit("/"), F.array_join("tpl", "/"))).otherwise("")
    return out.select("host", "segs", template.alias("template"), "purity", F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", bad=None) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for each row of ``pages``.

    rules: (block or allow, "host/path"); a rule fits its host and all subdomains if the path starts
    with its path; the longest wins. Other URLs get their template's verdict: per host the
    path segments form a tree, of any depth, in which numbers and nodes with many even children are
    wildcards; branches with like labelled rates merge, at every level; a template is blocked if
    the share of bad labels of the branch it is merged into, smoothed towards its host's, is at least REJECT. labels: (label_id, and what ``bad`` reads,
    by default toxic or low quality), matched to the pages by identifier; of several labels of one
    identifier the worst counts. A null URL or one without "://" has an empty host and path and is
    judged like others; rows that share an identifier stay; without any labels all is allowed.
    """
    bad = bad if bad is not None else ((F.col("toxic") == 1) | (F.col("quality") == 0))
    marks = labels.select(F.col(label_id).alias("__lid"), F.coalesce(bad, F.lit(False)).cast("int").alias("__bad")).where(F.col("__lid").isNotNull()).groupBy("__lid").agg(F.max("__bad").alias("__bad"))
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path")).withColumn("segs", _segments(F.col("path")))
    known = rows.join(marks, rows["__id"] == marks["__lid"], "left")
    urls = known.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("__bad").alias("labelled"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"))
    judged = template_verdicts(stored(urls, "url-templates"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(judged.withColumnRenamed("verdict", "learned"), ["host", "segs"], "left")
    return out.select(F.col("__id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(fixed, F.col("learned"), F.lit("allow")).alias("verdict"), "template", "purity")
