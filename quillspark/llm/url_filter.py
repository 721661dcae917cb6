"""URL filters: path rules, and for the rest gradient-boosted trees on lexical features.

The trees are trained from labelled URLs: a table of url and bad (0 or 1), or, where none is given, the URLs of the pages
that a path rule judges, with its verdict as the label; the trees then carry the rules' verdicts over to URLs that look
alike. They see shape only (lengths, depth, digits, hyphens, entropy, parameters) and statistics of the host's suffix,
which are counted over all URLs and all labels; a URL that the trees are trained on gets them without its own fold, as
they would tell its label otherwise. The trees are trained on the driver on a bounded sample (TRAIN_ROWS rows, least by
hash of the URL), and judge every URL as one Spark expression of built-in functions.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is judged by its shape alone; rows that
repeat are judged alike; labels that are null, and labelled URLs without a host, do not count; a sample with one class
only, or none, gives a constant model; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import docs_table, written

#: (verdict, host, path); fixed by contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: At most so many labelled rows train the trees.
TRAIN_ROWS = 20_000
#: Parts of the labelled URLs; a suffix's rate is worked out for a part from the others.
FOLDS = 5
#: Suffixes up to this number are broadcast.
SMALL_SUFFIXES = 50_000
FEATURES = ("url_chars", "host_chars", "path_chars", "host_labels", "depth", "digit_ratio", "hyphens", "entropy", "n_params", "suffix_rate", "suffix_share")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(pages: DataFrame, *keep: str) -> DataFrame:
    """url (null as empty), host and path."""
    url = F.coalesce("url", F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    base = pages.select(*keep, url.alias("url"), rest.alias("_rest"))
    host, path = F.regexp_extract("_rest", r"^[^/?#]*", 0), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    return base.select(*keep, "url", F.translate(host, _UPPER, _LOWER).alias("host"), path.alias("path"))


def rule_column(rules: tuple = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null: one CASE, longest first."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character, from the count of each distinct character."""
    chars = F.split(text, "")
    n = F.length(text)
    count = lambda c: n - F.length(F.replace(text, c, F.lit("")))
    share = F.transform(F.array_distinct(chars), lambda c: count(c) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


def suffix_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def shape_features() -> dict[str, Column]:
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    return {
        "url_chars": F.length(url).cast("double"),
        "host_chars": F.length(host).cast("double"),
        "path_chars": F.length(path).cast("double"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "entropy": entropy(host),
        "n_params": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
    }


@dataclass
class Trees:
    """Boosted regression trees for the log odds; a tree is a nested tuple (feature, threshold, low side, high side) or a leaf."""

    base: float
    trees: list = field(default_factory=list)

    def column(self, features: tuple = FEATURES) -> Column:
        def node(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(F.col(features[t[0]]) <= t[1], node(t[2])).otherwise(node(t[3]))

        return reduce(lambda a, b: a + b, map(node, self.trees), F.lit(float(self.base)))

    def score(self, x: np.ndarray) -> np.ndarray:
        def node(t, rows: np.ndarray) -> np.ndarray:
            if not isinstance(t, tuple):
                return np.full(len(rows), t)
            low = rows[:, t[0]] <= t[1]
            out = np.empty(len(rows))
            out[low], out[~low] = node(t[2], rows[low]), node(t[3], rows[~low])
            return out

        return self.base + sum((node(t, x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0) -> Trees:
    """Newton boosting for log loss; splits at quantiles, gains from gradient histograms."""
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
    model = Trees(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33))[:-1]) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: at most cut b
    score = np.full(len(y), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = -g[rows].sum() / (h[rows].sum() + ridge)
        if not left or len(rows) < 2 * least:
            return float(rate * value)
        best, where = 1e-9, None
        for f, c in enumerate(cuts):
            size = len(c) + 1
            gs, hs, ns = (np.cumsum(np.bincount(bins[rows, f], w, size))[:-1] for w in (g[rows], h[rows], None))
            gt, ht = g[rows].sum(), h[rows].sum()
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            if gain.max(initial=0) > best:
                best, where = gain.max(), (f, int(gain.argmax()))
        if where is None:
            return float(rate * value)
        f, b = where
        low = bins[rows, f] <= b
        return (f, float(cuts[f][b]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        score += Trees(0.0, [tree]).score(x)
        model.trees.append(tree)
    return model


@dataclass
class UrlModel:
    trees: Trees
    #: suffix, n (URLs), labelled and bad: of every suffix of the pages and labels that it was trained for.
    suffixes: DataFrame
    n_suffixes: int
    total: int
    prior: float

    def with_features(self, parts: DataFrame) -> DataFrame:
        """parts with the features; suffixes that the model does not know get the prior and 0."""
        known = self.suffixes.select("suffix", F.col("n").alias("_n"), F.col("labelled").alias("_labelled"), F.col("bad").alias("_bad"))
        both = parts.withColumns(shape_features()).withColumn("suffix", suffix_of(F.col("host")))
        both = both.join(F.broadcast(known) if self.n_suffixes <= SMALL_SUFFIXES else known, "suffix", "left")
        return both.withColumns(self.statistics()).drop("_n", "_labelled", "_bad", "suffix")

    def statistics(self) -> dict[str, Column]:
        """suffix_rate, the smoothed share of bad URLs among the suffix's labelled ones, and suffix_share of all URLs."""
        rate = (F.col("_bad") + 20 * self.prior) / (F.col("_labelled") + 20)
        return {"suffix_rate": F.coalesce(rate, F.lit(self.prior)), "suffix_share": F.coalesce(F.col("_n") / self.total, F.lit(0.0))}


def ruled_labels(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """url and bad of the pages that a rule judges."""
    judged = url_parts(pages).select("url", rule_column(rules).alias("_rule")).where("_rule IS NOT NULL")
    return judged.select("url", (F.col("_rule.verdict") == "block").cast("int").alias("bad"))


def train(pages: DataFrame, labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> UrlModel:
    """labelled: url, bad. A model whose suffix statistics are those of all pages and labels, its trees of at most ``rows`` labels."""
    labelled = ruled_labels(pages) if labelled is None else labelled.where("bad IS NOT NULL")
    suffix, fold = suffix_of(F.col("host")).alias("suffix"), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int").alias("fold")
    parts = url_parts(labelled, "bad").where("host <> ''")
    seen = url_parts(pages).where("host <> ''").select(suffix, F.lit(-1).alias("fold"), F.lit(1).alias("n"), F.lit(0).alias("labelled"), F.lit(0).alias("bad"))
    told = parts.select(suffix, fold, F.lit(0).alias("n"), F.lit(1).alias("labelled"), F.col("bad").cast("int").alias("bad"))
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    folds = written(seen.unionByName(told).groupBy("suffix", "fold").agg(*sums("n", "labelled", "bad")), "suffixes")
    suffixes = folds.groupBy("suffix").agg(*sums("n", "labelled", "bad"))
    n_suffixes, total, n_labelled, n_bad = suffixes.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "labelled", "bad")]).first()
    model = UrlModel(Trees(0.0), suffixes, n_suffixes, max(total, 1), n_bad / n_labelled if n_labelled else 0.0)
    # a threshold on the hash lets through a few more than are wanted, so that no task brings more than its share
    share = min(1.0, (1.1 * rows + 1000) / max(n_labelled, 1))
    key = F.xxhash64("url", F.lit(1)).alias("k")
    sample = parts.select(key, "bad", suffix, fold, *[c.alias(n) for n, c in shape_features().items()]).where(F.pmod("k", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("k").limit(rows)
    mine = folds.where("fold >= 0").select("suffix", "fold", F.col("labelled").alias("own"), F.col("bad").alias("own_bad"))
    known = suffixes.join(mine, "suffix").select("suffix", "fold", F.col("n").alias("_n"), (F.col("labelled") - F.col("own")).alias("_labelled"), (F.col("bad") - F.col("own_bad")).alias("_bad"))
    got = sample.join(known, ["suffix", "fold"], "left").withColumns(model.statistics()).orderBy("k", *FEATURES).collect()
    y = np.array([r["bad"] for r in got], float)
    x = np.array([[r[n] for n in FEATURES] for r in got], float).reshape(-1, len(FEATURES))
    model.trees = boost(x, y)
    return model


def judge(pages: DataFrame, model: UrlModel, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of bad): the rule's verdict, else the trees'."""
    parts = url_parts(pages, "page_id").withColumn("_rule", rule_column(rules))
    scored = model.with_features(parts).withColumn("score", model.trees.column())
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = docs_table(spark, sf_dir, "pages")
    return judge(pages, train(pages))
