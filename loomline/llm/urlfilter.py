"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Everything is DataFrame expressions: features are binned to small integers, trees are grown level by level from
gradient histograms aggregated over the labelled sample (the driver sees leaves x features x bins sums and nothing
else), and a finished model is a column expression of nested conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs that the trees are grown on at most (those with the smallest hash of the URL).
MAX_LABELLED = 20_000
BINS = 12
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "host_hyphens", "tld_share", "suffix_share", "segment_share")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://" up to /, ?, # or the end; A-Z lower-cased) and path (from there up to ?, # or the end)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def with_split(pages: DataFrame, url: str) -> DataFrame:
    """pages with host and path. They come from a generator of one row, through which the optimizer doesn't push later
    conditions: it would copy the expressions into each of their many uses."""
    host, path = split_url(F.col(url))
    return pages.select("*", F.inline(F.array(F.struct(host.alias("host"), path.alias("path")))))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (like "example.com/de/") that fits the host or a parent of it and begins the path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}"), F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters."""
    n = F.length(text).cast("double")
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit(""))).cast("double")) / n)
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def _keys(host: Column, path: Column) -> dict[str, Column]:
    """What suffix statistics are kept of: the last label, the last two labels, and of the first path segment."""
    labels = F.split(host, "\\.")
    last = F.element_at(labels, -1)
    return {"tld": last, "suffix": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2))), "segment": F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(2)), F.lit(""))}


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return {
        "url_length": F.log2(F.length(url) + 1.0),
        "host_length": F.log2(F.length(host) + 1.0),
        "path_length": F.log2(F.length(path) + 1.0),
        "depth": count(path, "/").cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n * 20,
        "entropy": _entropy(url) * 2,
        "parameters": (F.when(F.locate("?", url) > 0, count(url, "&") + 1).otherwise(0)).cast("double"),
        "host_labels": count(host, ".").cast("double"),
        "host_hyphens": count(host, "-").cast("double"),
    }


@dataclass
class Forest:
    """suffixes: kind, key, labels 1 and rows of each; trees: splits of each level by leaf and the values of the leaves."""

    suffixes: DataFrame
    share: float
    smooth: float
    trees: list[tuple[list[dict[int, tuple[int, int]]], dict[int, float]]]
    bias: float

    def margin(self, bins: Column) -> Column:
        out = F.lit(self.bias)
        for levels, values in self.trees:
            out = out + _branch(levels, values, bins, 0, 0)
        return out


def _branch(levels: list[dict[int, tuple[int, int]]], values: dict[int, float], bins: Column, level: int, leaf: int) -> Column:
    """The value of a tree from one of its nodes on: each condition is evaluated once."""
    if level == len(levels) or leaf not in levels[level]:
        return F.lit(values.get(leaf << (len(levels) - level), 0.0))
    f, b = levels[level][leaf]
    right, left = (_branch(levels, values, bins, level + 1, 2 * leaf + side) for side in (1, 0))
    return F.when(bins[f] > b, right).otherwise(left)


def _leaf(levels: list[dict[int, tuple[int, int]]], bins: Column) -> Column:
    leaf = F.lit(0)
    for splits in levels:
        side = F.lit(0)
        for i, (f, b) in splits.items():
            side = F.when(leaf == i, (bins[f] > b).cast("int")).otherwise(side)
        leaf = leaf * 2 + side
    return leaf


def _binned(urls: DataFrame, suffixes: DataFrame, share: float, smooth: float, label: str | None = None) -> DataFrame:
    """urls (url, host, path, ...) with bins, an array of small integers.

    Shares of label 1 are of the labelled URLs with the same key; of a labelled row (with ``label``) its own is left out.
    """
    out, values = urls, _lexical(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))
    own = {}
    for kind, key in _keys(F.col("host"), F.col("path")).items():
        name = f"loomline {kind}"
        while any(c.lower().startswith(name) for c in urls.columns):
            name += " "
        own[kind] = name
        side = suffixes.where(F.col("kind") == kind).select(F.col("key").alias(name), F.col("ones").alias(f"{name} ones"), F.col("n").alias(f"{name} n"))
        # bounded: at most one row for each labelled URL of the sample
        out = out.withColumn(name, key).join(F.broadcast(side), name, "left")
        ones, n = F.coalesce(F.col(f"{name} ones"), F.lit(0.0)), F.coalesce(F.col(f"{name} n"), F.lit(0))
        if label:
            ones, n = ones - F.col(label), n - 1
        values[f"{kind}_share"] = (ones + smooth * share) / (n + smooth) * (BINS - 1)
    bins = F.array(*(F.least(F.greatest(F.floor(values[f]), F.lit(0)), F.lit(BINS - 1 if f.endswith("share") else 24)).cast("int") for f in FEATURES))
    out = out.select("*", F.inline(F.array(F.struct(bins.alias("bins")))))
    return out.drop(*(x for n in own.values() for x in (n, f"{n} ones", f"{n} n")))


def fit(labelled: DataFrame, trees: int = 8, depth: int = 2, rate: float = 0.5, smooth: float = 4.0, max_labelled: int = MAX_LABELLED) -> Forest:
    """Grow trees on labelled URLs: url, label (1: block).

    At most ``max_labelled`` rows are used; rows with a null label are left out. Without rows of both labels there are
    no trees, and the bias alone decides.
    """
    sample = labelled.where("label in (0, 1)").select("url", F.col("label").cast("double").alias("label"))
    sample = sample.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled)
    sample = materialize(with_split(sample, "url"), "urls")
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (ones + 1) / (n + 2)
    keys = _keys(F.col("host"), F.col("path"))
    stats = sample.select("label", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()))).alias("s"))
    suffixes = materialize(stats.groupBy("s.kind", "s.key").agg(F.sum("label").alias("ones"), F.count("*").alias("n")), "suffixes")
    forest = Forest(suffixes, share, smooth, [], math.log(share / (1 - share)))
    if not 0 < ones < n:
        return forest
    # equal rows stand together, with their count
    rows = materialize(_binned(sample, suffixes, share, smooth, "label").groupBy("bins", "label").agg(F.count("*").cast("double").alias("n")), "binned")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-forest.margin(F.col("bins"))))
        graded = rows.select("bins", (F.col("n") * (F.col("label") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        levels: list[dict[int, tuple[int, int]]] = []
        values: dict[int, float] = {}
        for level in range(depth):
            hist = graded.withColumn("leaf", _leaf(levels, F.col("bins"))).select("leaf", "g", "h", F.posexplode("bins").alias("f", "b"))
            splits, values = _split(hist.groupBy("leaf", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect(), rate)
            levels.append(splits)
        forest.trees.append((levels, values))
    return forest


def _split(cells: list, rate: float, ridge: float = 1.0) -> tuple[dict[int, tuple[int, int]], dict[int, float]]:
    """For each leaf its best (feature, last bin of the left side), and the values of the leaves below."""
    splits, values = {}, {}
    for leaf in sorted({c.leaf for c in cells}):
        best, total = (0.0, 0, 1 << 20, 0.0, 0.0), None
        for f in range(len(FEATURES)):
            own = sorted((c.b, c.g, c.h) for c in cells if c.leaf == leaf and c.f == f)
            total = (math.fsum(x[1] for x in own), math.fsum(x[2] for x in own))
            g = h = 0.0
            for b, gb, hb in own[:-1]:
                g, h = g + gb, h + hb
                gain = g * g / (h + ridge) + (total[0] - g) ** 2 / (total[1] - h + ridge) - total[0] ** 2 / (total[1] + ridge)
                if gain > best[0] + 1e-9:
                    best = (gain, f, b, g, h)
        _, f, b, g, h = best
        splits[leaf] = (f, b)
        if best[0] == 0.0:
            g, h = total
        values[2 * leaf] = rate * g / (h + ridge)
        values[2 * leaf + 1] = rate * (total[0] - g) / (total[1] - h + ridge)
    return splits, values


def filter_urls(pages: DataFrame, rules: dict[str, str], forest: Forest, url: str = "url") -> DataFrame:
    """pages with host, path, rule, probability (of block, by the trees) and verdict (the rule's, else block from a half).

    Columns of pages with these names are replaced. A null url, or one without "://", has empty host and path, fits no rule, and is judged by its features.
    """
    out = with_split(pages.drop("host", "path", "rule", "probability", "verdict", "bins"), url)
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    had = "url" in out.columns
    out = out.withColumnsRenamed({"url": "loomline other"} if had and url != "url" else {}).withColumn("url", F.col(url))
    out = _binned(out, forest.suffixes, forest.share, forest.smooth)
    out = out.withColumn("probability", 1 / (1 + F.exp(-forest.margin(F.col("bins"))))).drop("bins")
    out = out if url == "url" else out.drop("url").withColumnsRenamed({"loomline other": "url"} if had else {})
    said = _of_rule({r: F.lit(v) for r, v in rules.items()})
    return out.withColumn("verdict", F.coalesce(said, F.when(F.col("probability") >= 0.5, "block").otherwise("allow")))


def labelled_by_rules(pages: DataFrame, rules: dict[str, str], url: str = "url") -> DataFrame:
    """The URLs that a rule decides, as labelled ones: url, label (1: block)."""
    out = with_split(pages.select(F.col(url).alias("url")), "url")
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return out.withColumn("label", _of_rule({r: F.lit(int(v == "block")) for r, v in rules.items()})).select("url", "label").where("label is not null")


def _of_rule(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for r, v in values.items():
        out = F.when(F.col("rule") == r, v).otherwise(out)
    return out
