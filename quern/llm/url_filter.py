"""URL filter: fixed host and path rules first, then a tree of path templates per host with learned verdicts.

A path segment is kept by name where enough labelled pages of its host have it at its place, whatever its characters;
all others become `*` at once. Level by level, the named branches below a node whose labelled share does not differ
significantly from that of their siblings are merged into `*` as well. A template is rejected if its purity, the share
of good labels smoothed towards its host and all pages, is too low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.core import col, materialize
from quern.llm.batches import without

WILD = "*"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path) and verdict of the longest (verdict, host, path) rule that fits, else null.

    A rule fits its host and its subdomains, for paths that start with its own.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The segments of a path; empty ones do not count."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def generalise(paths: DataFrame, least: int) -> DataFrame:
    """(host, path, raw): the segments of each path, rare ones as `*`. `paths` has host, path, labelled (stored).

    A segment keeps its name if at least `least` labelled pages of the host have it at that place, and as many other
    labelled pages of the host do not: no other segment can differ from its siblings.
    """
    each = paths.select("host", "path", "labelled", F.posexplode_outer(segments(F.col("path"))).alias("at", "segment"))
    counts = each.where("at is not null and labelled > 0").groupBy("host", "at", "segment").agg(F.sum("labelled").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("labelled").alias("all"))
    often = counts.where(F.col("n") >= least).join(hosts, "host").where(F.col("all") - F.col("n") >= least)
    named = each.join(often.select("host", "at", "segment", F.lit(True).alias("often")), ["host", "at", "segment"], "left")
    label = F.when(F.col("at").isNotNull(), F.struct("at", F.when(F.col("often"), F.col("segment")).otherwise(F.lit(WILD)).alias("label")))
    return named.groupBy("host", "path").agg(F.transform(F.sort_array(F.collect_list(label)), lambda x: x["label"]).alias("raw"))


def _merge_level(nodes: DataFrame, depth: int, least: int, z: float) -> DataFrame:
    """Merge similar branches at one depth: their segment becomes `*` in `done`.

    A branch stays on its own if it and its siblings have at least `least` labels each and their shares of bad
    labels differ by `z` standard errors or more.
    """
    here = nodes.withColumn("child", F.get("raw", depth))
    kids = here.where("child is not null").groupBy("host", "done", "child").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    all_kids = kids.groupBy("host", "done").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    both = kids.join(all_kids, ["host", "done"])
    rest_n, rest_b = F.col("pn") - F.col("n"), F.col("pb") - F.col("b")
    p = (F.col("pb") + 1) / (F.col("pn") + 2)
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), rest_n)))
    own = F.when((F.col("n") >= least) & (rest_n >= least) & (F.col("child") != WILD), F.abs(F.try_divide(F.col("b"), F.col("n")) - F.try_divide(rest_b, rest_n)) >= z * error).otherwise(F.lit(False))
    named = both.select("host", "done", "child", F.when(own, F.col("child")).otherwise(F.lit(WILD)).alias("label"))
    out = here.join(named, ["host", "done", "child"], "left")
    return out.select("host", "raw", F.when(F.col("label").isNull(), F.col("done")).otherwise(F.concat("done", F.lit("/"), "label")).alias("done"), "labelled", "bad")


def learn(pages: DataFrame, least: int = 10, z: float = 2.0, prior: float = 10.0) -> DataFrame:
    """(host, path, template, purity) for every distinct path, from host, path and bad (null: no label).

    Rows are summed per host and path first. Only places with a named segment are worked on, one job each over the
    distinct generalised paths: a deep path without such segments adds none. Purity is smoothed by `prior` labels of
    the host's share, which is smoothed by as many of the share of all pages.
    """
    sums = pages.groupBy("host", "path").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    sums = materialize(sums, "paths")
    raw = materialize(generalise(sums, least), "paths")
    nodes = sums.join(raw, ["host", "path"]).groupBy("host", "raw").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    nodes = materialize(nodes.select("host", "raw", F.lit("").alias("done"), "labelled", "bad"), "paths")
    total = nodes.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).collect()[0]
    named = nodes.select(F.posexplode("raw").alias("at", "segment")).where(F.col("segment") != WILD).select("at").distinct()
    upto = 0
    for depth in sorted(r["at"] for r in named.collect()):
        nodes = materialize(_merge_level(_skip(nodes, upto, depth), depth, least, z), "paths")
        upto = depth + 1
    nodes = _skip(nodes, upto, None)
    share = ((total["b"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    tree = nodes.groupBy("host", "done").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    hosts = tree.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    of_host = (F.col("hb") + prior * share) / (F.col("hn") + prior)
    bad = (F.col("b") + prior * of_host) / (F.col("n") + prior)
    judged = tree.join(hosts, "host").select("host", "done", F.round(1.0 - bad, 9).alias("purity"))
    found = nodes.select("host", "raw", "done").join(judged, ["host", "done"]).select("host", "raw", F.col("done").alias("template"), "purity")
    return raw.join(found, ["host", "raw"]).select("host", "path", "template", "purity")


def _skip(nodes: DataFrame, start: int, stop: int | None) -> DataFrame:
    """The nodes with their segments from `start` up to `stop`, all of them `*`, put into `done`."""
    size = F.size("raw") if stop is None else F.least(F.size("raw"), F.lit(stop))
    return nodes.withColumn("done", F.concat("done", F.repeat(F.lit("/" + WILD), F.greatest(size - start, F.lit(0)))))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", limit: float = 0.5) -> DataFrame:
    """Adds host, path, template, purity, rule and verdict to every page.

    `labels` has the key and `bad` (0 or 1); several labels of a key count as bad if one is. The longest fitting
    rule decides, else the template: `block` if its purity is below `limit`. Null urls are one template (empty host
    and path). Input columns with the new names are replaced.
    """
    kept = [col(c) for c in without(pages, ["host", "path", "template", "purity", "rule", "verdict", "raw", "bad", "_key"]).columns]
    host, path = parts(col(url).cast("string"))
    rows = pages.select(*kept, col(key).alias("_key"), host.alias("host"), path.alias("path"))
    known = labels.select(col(key).alias("_key"), F.col("bad").cast("long").alias("bad")).where("_key is not null").groupBy("_key").agg(F.max("bad").alias("bad"))
    tree = materialize(learn(rows.select("_key", "host", "path").join(known, "_key", "left")), "templates")
    name, said = matched_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(tree, ["host", "path"], "left").drop("_key")
    by_method = F.when(F.col("purity") < limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", name).withColumn("verdict", F.coalesce(said, by_method))
