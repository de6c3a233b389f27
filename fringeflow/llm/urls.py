"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the urls that no rule fits."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm.common import ascii_lower, let, table
from fringeflow.tables import materialise, scratch

#: (verdict, host, path): the contract's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The trees are fitted on this many labelled urls (those with the least hashes), or on all where there are fewer.
SAMPLE_URLS = 20_000
TREES, DEPTH, RATE, BINS, PENALTY = 8, 3, 0.4, 16, 1.0
#: The statistics of suffixes and folders, as a labelled url sees them, are of the urls of the other folds (by host).
FOLDS = 5
#: A rate is drawn to that of all labels as if by SMOOTHING urls; under LEAST_URLS labelled urls there are no statistics.
SMOOTHING, LEAST_URLS = 5.0, 20
LEXICAL = ("url_length", "host_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "longest_label", "first_label", "path_length")
#: What statistics are kept of: the host's suffix and the path's first folder. Null where they have none.
GROUPED = ("suffix", "folder")
STATISTICS = tuple(f"{g}_{what}" for g in GROUPED for what in ("rate", "share"))
NUMERIC = LEXICAL + STATISTICS


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or the end, A-Z lower-cased) and path (up to ? # or the end); both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def by_suffix(rule: Column) -> Column:
    """Whether the rule, as `ruled` returns it, names a bare suffix: then the suffix follows from the label's rule and says nothing more of the label."""
    return F.instr(F.substring_index(rule, "/", 1), ".") == 0


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host/path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, at, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        rule, verdict = F.when(fits, F.lit(at + under)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Of the characters, in bits."""

    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))

    return F.when(text == "", F.lit(0.0)).otherwise(let(F.split(text, ""), of))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    count = lambda column, pattern: F.regexp_count(column, F.lit(pattern)).cast("double")
    return {
        "url_length": F.char_length(text).cast("double"),
        "host_length": F.char_length(host).cast("double"),
        "labels": count(host, r"\."),
        "depth": count(path, "/"),
        "digit_ratio": count(text, "[0-9]") / F.greatest(F.char_length(text), F.lit(1)),
        "hyphens": count(host, "-"),
        "entropy": entropy(host),
        "parameters": F.when(query == "", F.lit(0.0)).otherwise(count(query, "&") + 1),
        "query_length": F.char_length(query).cast("double"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.char_length(x))).cast("double"),
        "first_label": F.char_length(F.substring_index(host, ".", 1)).cast("double"),
        "path_length": F.char_length(path).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def folder_of(path: Column) -> Column:
    """The path's first folder; empty without one."""
    return F.regexp_extract(path, "^/([^/]*)/", 1)


@dataclass
class Model:
    """base: the log odds to start from; trees: nested (feature, threshold, whether null goes low, low, high), leaves are
    numbers; statistics: for each of GROUPED a table of its value, rate and share."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    statistics: dict[str, DataFrame] = field(default_factory=dict)

    def margin(self) -> Column:
        """Of columns named as NUMERIC: over 0 is block. One expression, no function calls per row."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree_column(tree)
        return total


def _goes_low(tree) -> Column:
    name, threshold, null_low = tree[:3]
    return F.coalesce(F.col(name) <= F.lit(threshold), F.lit(null_low))


def tree_column(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(_goes_low(tree), tree_column(tree[3])).otherwise(tree_column(tree[4]))


def leaf_column(tree, at: int = 1) -> Column:
    """The number of the node that a row reaches: 1 at the root, 2n and 2n + 1 below n."""
    if isinstance(tree, float):
        return F.lit(at)
    return F.when(_goes_low(tree), leaf_column(tree[3], 2 * at)).otherwise(leaf_column(tree[4], 2 * at + 1))


def _grown(tree, at: int, splits: dict[int, tuple]):
    if isinstance(tree, float):
        return splits.get(at, tree)
    return (*tree[:3], _grown(tree[3], 2 * at, splits), _grown(tree[4], 2 * at + 1, splits))


def _best_split(by_feature: dict[int, dict[int, tuple[float, float]]], cuts: dict[str, list[float]]):
    """The split of a node with the best gain, its sides' values as leaves; None if none gains. Bins count from 1, 0 is null."""
    gs, hs = (sum(v[i] for v in by_feature[0].values()) for i in (0, 1))
    value = lambda g, h: float(RATE * g / (h + PENALTY))
    best = (1e-6, None)
    for k, by_bin in sorted(by_feature.items()):
        lost = by_bin.get(0, (0.0, 0.0))
        gl = hl = 0.0
        for b, threshold in enumerate(cuts[NUMERIC[k]], 1):
            gl, hl = gl + by_bin.get(b, (0, 0))[0], hl + by_bin.get(b, (0, 0))[1]
            for null_low in (False, True) if 0 in by_bin else (2 * hl > hs,):
                g, h = (gl + lost[0], hl + lost[1]) if null_low else (gl, hl)
                if h >= 1 and hs - h >= 1:
                    gain = round(g**2 / (h + PENALTY) + (gs - g) ** 2 / (hs - h + PENALTY) - gs**2 / (hs + PENALTY), 9)
                    if gain > best[0]:
                        best = (gain, (NUMERIC[k], float(threshold), null_low, value(g, h), value(gs - g, hs - h)))
    return best[1]


def _rates(group: str, rate: float, total: int) -> list[Column]:
    enough = F.col("n") >= LEAST_URLS
    return [F.when(enough, (F.col("blocked") + SMOOTHING * rate) / (F.col("n") + SMOOTHING)).alias(f"{group}_rate"), F.when(enough, F.col("n") / total).alias(f"{group}_share")]


def fit(labelled: DataFrame, url: str = "url", label: str = "label", key: str = "url", tied: Column | None = None, sample_urls: int = SAMPLE_URLS, trees: int = TREES) -> Model:
    """Gradient-boosted trees (logistic loss, second order) for label 1 (block) or 0 on the labelled urls.

    The statistics of a suffix or folder are sums over all labelled rows; a suffix's leave out those where `tied` is true:
    their label comes with the suffix, so that the rate would give the label away. A labelled url sees the sums of the
    other folds (by its host). Each url is learnt three times, as it is, as if its suffix were unknown, and its folder
    too, so that urls of an unknown suffix are judged by what all labels say of their other features. Trees grow level
    by level from histograms of the sample (sample_urls rows with the least hashes of key and url): each is one grouped
    sum of nodes x features x bins, and nothing else reaches the driver. Without rows of both labels the model is constant."""
    host, path = split_url(F.col(url))
    fold = F.pmod(F.xxhash64(F.lit("fold"), host), F.lit(FOLDS)).cast("int")
    given = labelled.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(label).alias("y"), suffix_of(host).alias("suffix"), folder_of(path).alias("folder"), fold.alias("fold"), F.coalesce(tied if tied is not None else F.lit(False), F.lit(False)).alias("tied"))
    total = given.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("blocked")).first()
    n, blocked = total["n"], total["blocked"]
    rate = (blocked + 1) / (n + 2)
    model = Model(base=math.log(rate / (1 - rate)))
    if not 0 < blocked < n:
        return model

    order = F.xxhash64(F.lit("sample"), "key", "url")
    # Twice the share that is wanted of the hashes, of which the least are taken.
    near = given.filter(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < 2 * sample_urls / n)
    seen = near.orderBy(F.pmod(order, F.lit(1 << 30)), "url").limit(sample_urls)
    for group in GROUPED:
        counted = given.filter("NOT tied") if group == "suffix" else given
        sums = materialise(counted.groupBy(group, "fold").agg(F.count("*").alias("n_in"), F.sum("y").alias("blocked_in")), "url-sums")
        whole = sums.groupBy(group).agg(F.sum("n_in").alias("n"), F.sum("blocked_in").alias("blocked"))
        model.statistics[group] = materialise(whole.select(group, *_rates(group, rate, n)).filter(f"{group}_rate IS NOT NULL"), "url-statistics", keep=True)
        seen = seen.join(whole, group, "left").join(sums, [group, "fold"], "left")
        out = lambda c: F.coalesce(c, F.lit(0)) - F.coalesce(f"{c}_in", F.lit(0))
        seen = seen.withColumns({"n": out("n"), "blocked": out("blocked")}).select("*", *_rates(group, rate, n)).drop("n", "blocked", "n_in", "blocked_in")
    copies = seen.withColumn("__known", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    hidden = {c: F.when(F.col("__known") > GROUPED.index(c.split("_")[0]), F.lit(None)).otherwise(F.col(c)) for c in STATISTICS}
    # 0: as it is; 1: without the suffix's statistics; 2: without the folder's too.
    copies = copies.select("url", F.col("y").cast("double").alias("y"), *(c.alias(name) for name, c in hidden.items()))
    host, path = split_url(F.col("url"))
    split = copies.select("*", host.alias("host"), path.alias("path"))
    lex = lexical(F.col("url"), F.col("host"), F.col("path"))
    learnt = materialise(split.select("y", *(lex[c].alias(c) for c in LEXICAL), *STATISTICS), "url-sample")
    edges = learnt.agg(*(F.percentile_approx(c, [k / BINS for k in range(1, BINS)], 1000).alias(c) for c in NUMERIC)).first()
    cuts = {c: sorted(set(edges[c] or [])) for c in NUMERIC}
    bin_of = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(sum(((F.col(c) > F.lit(x)).cast("int") for x in cuts[c]), F.lit(1)))
    binned = materialise(learnt.select("y", *NUMERIC, F.array(*(bin_of(c) for c in NUMERIC)).alias("bins")), "url-bins")

    for _ in range(trees):
        tree: float | tuple = 0.0
        p = 1 / (1 + F.exp(-model.margin()))
        for _ in range(DEPTH):
            rows = binned.select(leaf_column(tree).alias("node"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), "bins")
            each = rows.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
            found: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for x in each.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                found.setdefault(x["node"], {}).setdefault(x["feature"], {})[x["bin"]] = (x["g"], x["h"])
            splits = {node: split for node, by_feature in found.items() if (split := _best_split(by_feature, cuts))}
            if not splits:
                break
            tree = _grown(tree, 1, splits)
        if isinstance(tree, float):
            break
        model.trees.append(tree)
    return model


def features(rows: DataFrame, url: str, model: Model, keep: list[Column]) -> DataFrame:
    """keep, host, path and the columns NUMERIC. Statistics are looked up in tables, which Spark broadcasts if they're small."""
    host, path = split_url(F.col(url))
    split = rows.select(*keep, F.col(url).alias("__url"), host.alias("host"), path.alias("path"))
    lex = lexical(F.col("__url"), F.col("host"), F.col("path"))
    found, of = split, {"suffix": suffix_of(F.col("host")), "folder": folder_of(F.col("path"))}
    for group in GROUPED:
        if group in model.statistics:
            found = found.join(model.statistics[group].withColumnRenamed(group, "__group"), of[group] == F.col("__group"), "left").drop("__group")
        else:
            found = found.withColumns({f"{group}_{what}": F.lit(None).cast("double") for what in ("rate", "share")})
    return found.select(*split.columns, *(lex[c].alias(c) for c in LEXICAL), *STATISTICS)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, model: Model | None = None) -> DataFrame:
    """key, host, path, rule, verdict, margin for each row of pages. The rules' verdicts label the urls that the trees learn from,
    unless a model is given; the trees judge the urls without a rule. A null url, or one without ://, has an empty host
    and path, fits no rule and is judged like any other. Repeated rows agree. Where all labels are the same, so is the verdict."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    if model is None:
        rule, verdict = ruled(host, path, rules)
        labelled = rows.select("key", "url", rule.alias("rule"), verdict.alias("verdict")).filter("verdict IS NOT NULL")
        with scratch(pages.sparkSession):
            model = fit(labelled.select("key", "url", (F.col("verdict") == "block").cast("int").alias("label"), by_suffix(F.col("rule")).alias("tied")), key="key", tied=F.col("tied"))
    found = features(rows, "url", model, [F.col("key")])
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    scored = found.select("key", "host", "path", rule.alias("rule"), verdict.alias("ruled"), model.margin().alias("margin"))
    learned = F.when(F.col("margin") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "margin")


def op2_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; see judge for nulls and repeated rows."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
