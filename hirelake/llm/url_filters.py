"""URL filters: explicit host/path rules first, then a path-template tree learnt from the urls the rules decide.

Per host, variable segments become wildcards: lexically (digits, hashes, very long segments), and where a node has
MIN_CHILDREN different children, whatever the number of rows. Wildcards are looked for at all depths at once, again on the
merged tree while new ones appear. Every node of the tree, from the host to the full template, has counts of the labelled
urls below it. Sibling branches whose block rates don't differ significantly from their parent's are merged: they share
their counts. A template's purity is smoothed from the host downwards, each node's counts against its parent's purity, so
a branch without labels takes the purity of its nearest labelled ancestor; templates of high purity are rejected.

All steps are joins and aggregations of (host, template) tables, never of whole hosts in one task. Templates that hold
over 1 / HOT of all rows (at most HOT of them) reach their pages by broadcast, the others by shuffle.

Defined cases: null urls and urls without ``://`` have an empty host and path, match no rule and share one template;
repeated urls count as often as they occur; a host without labelled urls is allowed (purity 0.5); the segments of a path
from number MAX_DEPTH on count as one; urls of any length are read whole; null ids pass through; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, lower_ascii

#: The rules (verdict, rule) of the contract.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
MAX_DEPTH = 64
MIN_CHILDREN = 8
Z = 1.96
#: Weight of the parent's purity, in labelled urls; the host's parent has purity PRIOR.
WEIGHT, PRIOR = 2.0, 0.5
MIN_PURITY = 0.8
LONG_SEGMENT = 40
HOT = 4096


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Rules are a short list of settings, not data."""
    rule, verdict = None, None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut_at = text.index("/")
        h, p = text[:cut_at], text[cut_at:]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def lexical_template(path: Column) -> Column:
    """Segments with digits, hashes and long strings replaced by wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    tail = F.array(F.array_join(F.slice(segments, MAX_DEPTH, F.greatest(F.size(segments), F.lit(1))), "/"))
    folded = F.when(F.size(segments) > MAX_DEPTH, F.concat(F.slice(segments, 1, MAX_DEPTH - 1), tail)).otherwise(segments)
    return F.transform(
        folded,
        lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{x}"))
        .when(F.length(s) > LONG_SEGMENT, F.lit("{s}"))
        .otherwise(F.regexp_replace(s, "[0-9]+", "{n}")),
    )


def _prefix(template: Column, length: Column) -> Column:
    return F.array_join(F.slice(template, F.lit(1), length), "/")


def generalise(tree: DataFrame) -> DataFrame:
    """tree (host, lex, tmpl, ...) with wildcards for the children of nodes with many different ones, at any depth."""
    while True:
        places = tree.select("host", "lex", F.posexplode("tmpl").alias("pos", "segment"), "tmpl").withColumn("parent", _prefix(F.col("tmpl"), F.col("pos"))).drop("tmpl")
        kinds = places.filter("segment <> '*'").select("host", "parent", "pos", "segment").distinct()
        many = kinds.groupBy("host", "parent", "pos").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= MIN_CHILDREN).select("host", "parent", "pos", F.lit("*").alias("wild"))
        if not many.limit(1).count():
            return tree
        told = places.join(many, ["host", "parent", "pos"], "left").groupBy("host", "lex").agg(
            F.sort_array(F.collect_list(F.struct("pos", F.coalesce("wild", "segment").alias("segment")))).alias("placed")
        )
        merged = tree.join(told, ["host", "lex"], "left").withColumn("tmpl", F.coalesce("placed.segment", "tmpl")).drop("placed")
        before, tree = tree, cut(merged, "url-tree")
        discard(before)


def purities(tree: DataFrame) -> DataFrame:
    """host, tmpl and the smoothed purity of every template of tree (host, tmpl, labelled, blocked)."""
    c = F.col
    templates = tree.groupBy("host", "tmpl").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    depths = F.explode(F.sequence(F.lit(0), F.size("tmpl"))).alias("depth")
    below = templates.filter("labelled > 0").select("host", "tmpl", "labelled", "blocked", depths)
    path, parent = _prefix(c("tmpl"), c("depth")), _prefix(c("tmpl"), F.greatest(c("depth") - 1, F.lit(0)))
    nodes = below.select("host", "depth", path.alias("path"), parent.alias("parent"), "labelled", "blocked")
    nodes = nodes.groupBy("host", "depth", "path", "parent").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    nodes = cut(nodes, "url-nodes")
    up = nodes.select("host", (c("depth") + 1).alias("depth"), c("path").alias("parent"), (c("b") / c("l")).alias("rate"))
    alike = F.abs(c("b") / c("l") - c("rate")) <= Z * F.sqrt(c("rate") * (1 - c("rate")) / c("l")) + 1e-12
    nodes = nodes.join(up, ["host", "depth", "parent"], "left").withColumn("merged", F.coalesce(alike, F.lit(False)))
    groups = nodes.filter("merged").groupBy("host", "depth", "parent").agg(F.sum("l").alias("gl"), F.sum("b").alias("gb"))
    both = nodes.join(groups, ["host", "depth", "parent"], "left")
    pick = lambda group, own: F.when(c("merged"), c(group)).otherwise(c(own)).cast("double")
    told = both.select("host", "depth", "path", pick("gl", "l").alias("l"), pick("gb", "b").alias("b"))
    chain = templates.select("host", "tmpl", depths).withColumn("path", _prefix(c("tmpl"), c("depth"))).join(told, ["host", "depth", "path"])
    chain = chain.groupBy("host", "tmpl").agg(F.sort_array(F.collect_list(F.struct("depth", "l", "b"))).alias("chain"))
    smooth = lambda p, x: (x["b"] + WEIGHT * p) / (x["l"] + WEIGHT)
    purity = F.aggregate("chain", F.lit(PRIOR), smooth)
    return templates.join(chain, ["host", "tmpl"], "left").select("host", "tmpl", F.coalesce(purity, F.lit(PRIOR)).alias("purity"))


def url_filters(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row a page: key, host, path, rule, verdict, template, purity."""
    host, path = split_url(F.col(url))
    base = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), said.alias("said"), lexical_template(F.col("path")).alias("lex"))
    leaves = base.groupBy("host", "lex").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("said").alias("labelled"),
        F.count(F.when(F.col("said") == "block", 1)).alias("blocked"),
    )
    tree = generalise(cut(leaves.withColumn("tmpl", F.col("lex")), "url-leaves"))
    by_leaf = cut(tree.select("host", "lex", "tmpl", "n").join(purities(tree), ["host", "tmpl"]), "url-verdicts")
    rows = by_leaf.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = (F.col("n") * HOT > rows) if rows else F.lit(False)
    often = by_leaf.filter(hot).select("host", "lex", "tmpl", "purity")
    seldom = by_leaf.filter(~hot).select("host", "lex", "tmpl", "purity")
    judged = base.join(F.broadcast(often), ["host", "lex"]).unionByName(
        base.join(F.broadcast(often.select("host", "lex")), ["host", "lex"], "left_anti").join(seldom, ["host", "lex"])
    )
    learnt = F.when(F.col("purity") >= MIN_PURITY, "block").otherwise("allow")
    return judged.select(
        key,
        "host",
        "path",
        "rule",
        F.coalesce("said", learnt).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("tmpl", "/")).alias("template"),
        "purity",
    )
