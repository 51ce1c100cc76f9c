"""URL filters: host and path rules first, then a tree of path templates, in DataFrame operations only.

Rules are (host, path) pairs; a rule fits its host and all subdomains if the path starts with the rule's.
The longest rule that fits gives the verdict.

For all other urls the method decides. Per host, paths form a tree of segments. Level by level a segment
becomes a wildcard where the values under its parent vary: numbers always, other values where distinct
ones are many for the distinct paths seen. A template is the path with its wildcards, and every node of the tree, from the
host down, counts the labelled urls below it.

From the host down, sibling branches are put in order of their share of good labels, by hundredths, and neighbours
whose shares don't differ by ``MERGE_Z`` standard errors are merged into one branch with one share. A branch whose
share doesn't differ so from its parent's takes the parent's; others are smoothed by it. A branch without labels has its
parent's share, a host is judged against the whole table; on a host without any label, a template has its share over all
hosts. A template whose share falls below ``PURITY`` is rejected.

Siblings are summed by hundredths of a share before they meet, so that a parent gathers a hundred sums at most, and not its
branches.

Labels are the verdicts of the rules unless other ones are passed in.

Defined cases: a null url, or one without ``://``, has an empty host and path; urls with no label near them
keep the share of the whole table, and 1 if there is no label at all; ties between equally long rules go
to the longer host; repeated rows count as often as they occur
as labels, and once for templates; an empty table gives no rows; what follows the ``DEPTH`` th segment is one segment, slashes
and all; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.shared import save

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Levels of the tree.
DEPTH = 8
#: A value under one parent is a variable if there are at least this many and this share of distinct ones.
VARIABLE_DISTINCT, VARIABLE_SHARE = 8, 0.2
SMOOTHING, PURITY, MERGE_Z = 4.0, 0.5, 1.96
#: Parts of a share by which siblings are summed.
SHARES = 100
WILDCARD = "*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substr(url, cut + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    """The segments of a path, numbers as wildcards; what follows the last level is one segment."""
    parts = F.slice(F.split(path, "/", DEPTH + 1), 2, DEPTH)
    number = lambda x: F.when(x.rlike(r"^[0-9]+$"), F.lit(WILDCARD)).when(x.rlike(r"^[0-9]+\."), F.concat(F.lit(WILDCARD), F.regexp_extract(x, r"^[0-9]+(\..*)$", 1)))
    return F.transform(parts, lambda x: F.coalesce(number(x), x))


def path_templates(paths: DataFrame) -> DataFrame:
    """``paths`` (distinct host and path, with other columns) and ``nodes``: the node on each level of the tree, the host's first."""
    rows = paths.withColumn("segments", _segments(F.col("path"))).withColumn("nodes", F.array(F.lit("")))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for i in range(deepest):
        node, segment = F.element_at("nodes", -1), F.get("segments", F.lit(i))
        values = rows.filter(segment.isNotNull()).groupBy("host", node.alias("parent"), segment.alias("segment")).agg(F.count(F.lit(1)).alias("n"))
        variable = (
            values.groupBy("host", "parent")
            .agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n"))
            .filter((F.col("distinct") >= VARIABLE_DISTINCT) & (F.col("distinct") >= VARIABLE_SHARE * F.col("n")))
            .select(F.col("host").alias("v_host"), F.col("parent").alias("v_parent"))
        )
        rows = rows.join(variable, (F.col("host") == F.col("v_host")) & (node == F.col("v_parent")), "left")
        value = F.when(F.col("v_host").isNotNull(), F.lit(WILDCARD)).otherwise(segment)
        below = F.when(segment.isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array(F.concat(node, F.lit("/"), value))))
        rows = save(rows.withColumn("nodes", below).drop("v_host", "v_parent"), "url-templates")
    return rows.drop("segments")


def _share(good: Column, n: Column, parent: Column) -> Column:
    """The smoothed share of good labels, or the parent's if the two don't differ."""
    error = F.sqrt(parent * (1 - parent) / F.greatest(n, F.lit(1)))
    differs = (n > 0) & (F.abs(good / F.greatest(n, F.lit(1)) - parent) > MERGE_Z * error)
    return F.round(F.when(differs, (good + SMOOTHING * parent) / (n + SMOOTHING)).otherwise(parent), 9)


def branch_shares(bins: DataFrame) -> DataFrame:
    """``bins`` (host, parent, bin, n, good, parent_share) with the share of the branch that each is merged into."""
    siblings = Window.partitionBy("host", "parent").orderBy("bin")
    lag = lambda c: F.lag(c).over(siblings)
    pooled = (F.col("good") + lag("good")) / (F.col("n") + lag("n"))
    apart = F.abs(F.col("good") / F.col("n") - lag("good") / lag("n")) > MERGE_Z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / lag("n")))
    runs = bins.withColumn("branch", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(siblings))
    branch = Window.partitionBy("host", "parent", "branch")
    share = _share(F.sum("good").over(branch), F.sum("n").over(branch), F.col("parent_share"))
    return runs.select("host", "parent", "bin", share.alias("share"))


def judge_urls(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for rows of (page_id, url, optionally good 0/1)."""
    host, path = url_parts(F.col("url"))
    given = F.col("good").cast("double") if "good" in urls.columns else F.lit(None).cast("double")
    parts = urls.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), given.alias("given"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("ruling"))
    label = F.coalesce(F.col("given"), F.when(F.col("ruling").isNotNull(), (F.col("ruling") == "allow").cast("double")))
    counted = ruled.groupBy("host", "path").agg(F.count(label).cast("double").alias("n"), F.coalesce(F.sum(label), F.lit(0.0)).alias("good"))
    paths = path_templates(save(counted, "url-paths"))
    overall = paths.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("n")), F.lit(1.0)), F.max(F.size("nodes"))).first()
    # The share of the node that a path has reached; a level at a time.
    level = paths.select("host", "path", "nodes", "n", "good", F.lit(float(overall[0])).alias("share"), F.lit(False).alias("labelled"))
    for i in range(overall[1] or 0):
        here = F.get("nodes", F.lit(i))
        parent = F.get("nodes", F.lit(i - 1)) if i else F.lit("")
        tree = level.filter(here.isNotNull()).groupBy("host", parent.alias("parent"), here.alias("node")).agg(
            F.sum("n").alias("n"), F.sum("good").alias("good"), F.first("share").alias("parent_share")
        )
        tree = save(tree.filter("n > 0").withColumn("bin", F.round(F.col("good") / F.col("n") * SHARES).cast("int")), "url-nodes")
        bins = tree.groupBy("host", "parent", "bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.first("parent_share").alias("parent_share"))
        shares = tree.select("host", "parent", "node", "bin").join(branch_shares(bins), ["host", "parent", "bin"]).select(
            F.col("host").alias("s_host"), F.col("node").alias("s_node"), F.col("share").alias("own_share")
        )
        joined = level.join(shares, (F.col("host") == F.col("s_host")) & (here == F.col("s_node")), "left")
        joined = joined.withColumns({"share": F.coalesce("own_share", "share"), "labelled": F.col("labelled") | F.col("own_share").isNotNull()})
        level = save(joined.drop("s_host", "s_node", "own_share"), "url-shares")
    level = level.withColumn("template", F.element_at("nodes", -1))
    wide = level.groupBy("template").agg(F.sum("n").alias("w_n"), F.sum("good").alias("w_good")).filter("w_n > 0").withColumnRenamed("template", "w_template")
    everywhere = _share(F.col("w_good"), F.col("w_n"), F.lit(float(overall[0])))
    level = level.join(wide, ~F.col("labelled") & (F.col("template") == F.col("w_template")), "left").withColumn("purity", F.when(F.col("w_n").isNotNull(), everywhere).otherwise(F.col("share")))
    found = level.select(F.col("host").alias("t_host"), F.col("path").alias("t_path"), "template", "purity")
    judged = ruled.join(found, (F.col("host") == F.col("t_host")) & (F.col("path") == F.col("t_path")))
    own = F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), "template", "purity")
