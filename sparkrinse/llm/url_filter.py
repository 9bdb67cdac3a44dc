"""Judge urls by rules and by a tree of path templates per host.

Paths are first masked (every run of digits, every long hexadecimal run), then the tree grows level by
level over the distinct masked paths of each host: the children of a node become a wildcard where they
are many and rare, and sibling branches whose labelled shares do not differ significantly are merged, those
without labels apart from the others. A template whose smoothed share of good labels is too low is
rejected. Labels are what the rules say of the pages they fit. Shares lean to an even one, so a template
without a labelled page of its own is never rejected, whatever stands beside it on the host.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrinse.llm.words import lowered
from sparkrinse.staging import stage

# (verdict, host and path). A rule fits its host and all subdomains, for paths that start with its own.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# A node's children become a wildcard when there are so many and they have so few pages each.
LEAST_CHILDREN = 8
MOST_PAGES_PER_CHILD = 4.0
# Siblings are merged unless their shares differ by so many standard errors.
APART = 2.0
SMOOTHING = 4.0
# The share of a branch without labels, to which others lean.
EVEN = 0.5
LEAST_PURITY = 0.5
# Levels below this one are one open end of the template.
MOST_LEVELS = 12
NAMED_BRANCHES = 6


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one. The first of equal rules counts."""
    found = verdict = None
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none if found is None else found), (none if verdict is None else verdict)


def masked(path: Column) -> Column:
    """The path with ``~`` for long hexadecimal runs that hold a digit and ``#`` for other digit runs."""
    return F.regexp_replace(F.regexp_replace(path, r"(?=[a-f]*[0-9])[0-9a-f]{12,}", "~"), "[0-9]+", "#")


def template_table(paths: DataFrame) -> DataFrame:
    """Templates of ``paths`` (host, masked, n, labelled, bad): host, masked, template, purity.

    Nothing larger than the distinct masked paths of a host is ever brought together.
    """
    segments = F.split("masked", "/")
    nodes = stage(
        paths.select("host", "masked", segments.alias("parts"), F.lit("").alias("prefix"), "n", "labelled", "bad"), "url-paths"
    )
    depth = nodes.agg(F.max(F.size("parts"))).collect()[0][0] or 0
    for level in range(min(depth, MOST_LEVELS)):
        nodes = stage(_grow(nodes, level), "url-nodes")
    open_end = F.when(F.size("parts") > MOST_LEVELS, F.lit("/**")).otherwise(F.lit(""))
    leaves = nodes.withColumn("template", F.concat(F.regexp_replace("prefix", "^/", ""), open_end))
    shares = leaves.groupBy("host", "template").agg(
        ((F.sum("bad") + SMOOTHING * EVEN) / (F.sum("labelled") + SMOOTHING)).alias("share")
    )
    return leaves.select("host", "masked", "template").join(shares, ["host", "template"]).select(
        "host", "masked", "template", (1 - F.col("share")).alias("purity")
    )


def _grow(nodes: DataFrame, level: int) -> DataFrame:
    """Add one level to ``prefix``: a wildcard, a merged branch or the segment itself."""
    here = F.size("parts") > level
    part = F.get("parts", F.lit(level))
    branches = nodes.filter(here).groupBy("host", "prefix", part.alias("part")).agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    )
    totals = branches.groupBy("host", "prefix").agg(F.count("*").alias("children"), F.sum("n").alias("pages"))
    wild = (F.col("children") >= LEAST_CHILDREN) & (F.col("pages") <= MOST_PAGES_PER_CHILD * F.col("children"))
    known = branches.join(totals, ["host", "prefix"]).withColumn("wild", wild)
    # Branches in order of their smoothed share: a significant step up starts a new group.
    weight = F.col("labelled") + SMOOTHING
    rated = known.withColumn("weight", weight).withColumn("share", (F.col("bad") + SMOOTHING * EVEN) / weight)
    rated = rated.withColumn("told", F.col("labelled") > 0)
    order = Window.partitionBy("host", "prefix", "told").orderBy("share", "part")
    last_share, last_weight = F.lag("share").over(order), F.lag("weight").over(order)
    pooled = (F.col("share") * F.col("weight") + last_share * last_weight) / (F.col("weight") + last_weight)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("weight") + 1 / last_weight))
    step = F.when(F.col("share") - last_share > APART * error, 1).otherwise(0)
    grouped = rated.withColumn("step", step).withColumn("group", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = grouped.filter("not wild").groupBy("host", "prefix", "told", "group").agg(
        F.count("*").alias("size"), F.min("part").alias("least"), F.max("part").alias("most"), F.collect_list(
            F.when(F.col("children") <= NAMED_BRANCHES, F.col("part"))).alias("members"),
    )
    several = F.when(F.size("members") > 0, F.array_join(F.array_sort("members"), "|")).otherwise(F.concat_ws("..", "least", "most"))
    label = F.when(F.col("size") == 1, F.col("least")).otherwise(F.concat(F.lit("{"), several, F.lit("}")))
    merged = grouped.join(names.select("host", "prefix", "told", "group", label.alias("label")), ["host", "prefix", "told", "group"], "left").select(
        F.col("host").alias("b_host"), F.col("prefix").alias("b_prefix"), F.col("part").alias("b_part"),
        F.when(F.col("wild"), F.lit("*")).otherwise(F.col("label")).alias("label"),
    )
    on = (F.col("host") == F.col("b_host")) & (F.col("prefix") == F.col("b_prefix")) & (part == F.col("b_part"))
    grown = F.when(here, F.concat("prefix", F.lit("/"), "label")).otherwise(F.col("prefix"))
    return nodes.join(merged, on, "left").withColumn("prefix", grown).drop("b_host", "b_prefix", "b_part", "label")


def judge(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), template, purity.

    A rule's verdict counts before the template's. Null urls and urls without ``://`` share the empty
    host. Repeated rows give a row each; columns beyond the two named are not read.
    """
    url = F.col(url_column).cast("string")
    split = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("masked", masked(F.col("path")))
    paths = ruled.groupBy("host", "masked").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("bad")
    )
    templates = stage(template_table(paths), "url-templates")
    own = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    return ruled.join(templates, ["host", "masked"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity"
    )
