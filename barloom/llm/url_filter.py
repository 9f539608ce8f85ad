"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

The longest rule that fits decides. A URL that no rule judges is judged by trees trained from labelled
URLs: lengths, depth, digit ratio, character entropy, numbers of parameters, hyphens and subdomains, and
two statistics of the host suffix (its last two labels), its frequency over all URLs and its smoothed share
of blocked ones among the labelled. Where no other labels are given, the URLs that a rule judges are the labelled
ones, and the trees carry the rules over to hosts that they do not name.

How it scales: rules are a literal expression, features a projection; training takes at most about ``SAMPLE``
different labelled URLs, drawn by a hash of the URL, and a tenth of that at least of the rarer label; suffix statistics are aggregates over all URLs, joined without
a hint, so a frequent suffix is left to the skew join of the adaptive planner. Scoring is a map.

Null URLs and URLs without ``://`` have an empty host and path, no rule fits, and the trees judge them like
others. Without labels of both kinds everything else is allowed. Repeated rows give repeated results,
empty tables empty ones. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import ascii_lower
from barloom.session import written

SAMPLE = 20_000
TREES, DEPTH = 20, 4
PRIOR = 20.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.endswith(F.col("host"), F.lit("." + self.host))
        return host & F.startswith(F.col("path"), F.lit(self.path))


RULES = (
    Rule("com", "/", False), Rule("example.com", "/en/", True), Rule("www.example.com", "/en/", False),
    Rule("net", "/es/", True), Rule("net", "/fr/", True),
)
NUMBERS = (
    "url_length", "host_length", "path_length", "depth", "subdomains", "digit_ratio", "host_digits", "entropy",
    "n_params", "n_hyphens", "query_length", "secure", "suffix_log_count", "suffix_block_share",
)


def parts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path)."""
    after = F.when(F.contains("url", F.lit("://")), F.substr("url", F.locate("://", F.col("url")) + 3)).otherwise("")
    return pages.select(F.col("page_id"), F.col("url"), F.coalesce(after, F.lit("")).alias("after")).select(
        "page_id", "url",
        ascii_lower(F.regexp_extract("after", r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("after", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def ruled(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """With ``rule`` and ``blocked`` of the longest rule that fits, both null if none does."""
    rule, blocked = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(r.name())):  # longer ones last, so that they win
        rule = F.when(r.fits(), F.lit(r.name())).otherwise(rule)
        blocked = F.when(r.fits(), F.lit(r.block)).otherwise(blocked)
    return urls.withColumn("rule", rule).withColumn("blocked", blocked)


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    characters = F.split(text, "")
    share = lambda c: F.size(F.filter(characters, lambda x: x == c)) / F.size(characters)
    bits = F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    length = F.length(url).cast("double")
    labels = F.split(host, r"\.")
    return urls.withColumns({
        "url_length": length, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count_of(path, "/"), "subdomains": count_of(host, "."),
        "digit_ratio": F.when(length > 0, count_of(url, "0123456789") / length).otherwise(0.0),
        "host_digits": count_of(host, "0123456789"), "entropy": entropy(host),
        "n_params": F.when(query != "", count_of(query, "&") + 1).otherwise(0.0), "n_hyphens": count_of(host, "-"),
        "query_length": F.length(query).cast("double"), "secure": F.startswith(url, F.lit("https:")).cast("double"),
        "suffix": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."),
    })


def with_suffix_statistics(urls: DataFrame) -> DataFrame:
    labelled = F.col("label").isNotNull()
    statistics = urls.groupBy("suffix").agg(
        F.log1p(F.count("*").cast("double")).alias("suffix_log_count"),
        ((F.coalesce(F.sum("label"), F.lit(0.0)) + PRIOR / 2) / (F.sum(labelled.cast("double")) + PRIOR)).alias("suffix_block_share"),
    )
    return urls.join(statistics, "suffix").drop("suffix")


def fit(urls: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH):
    """Trees from the rows whose ``label`` (1: block) is not null; None without both labels."""
    # a URL once, however many pages it has
    known = urls.where("label is not null").groupBy("url", "label").agg(*[F.first(c).alias(c) for c in NUMBERS])
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    # of each label its part of the sample, but never less than a tenth of it
    share = {
        label: min(1.0, max(sample * n / sum(counts.values()), sample / 10) / n) for label, n in counts.items()
    }
    place = F.shiftrightunsigned(F.xxhash64("url"), 11) / float(1 << 53)
    chosen = known.where(place < F.when(F.col("label") == 1, share.get(1.0, 0.0)).otherwise(share.get(0.0, 0.0)))
    rows = VectorAssembler(inputCols=list(NUMBERS), outputCol="features").transform(chosen).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=1).fit(written(rows, "labelled-urls"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, p_block (null where a rule judges).

    ``labels``: (url, label), one row per URL, label 1 for block; the rules' verdicts by default."""
    urls = lexical(ruled(parts(pages), rules))
    if labels is None:
        urls = urls.withColumn("label", F.col("blocked").cast("double"))
    else:
        urls = urls.join(labels.select("url", F.col("label").cast("double")), "url", "left")
    rows = written(with_suffix_statistics(urls).select("page_id", "host", "path", "url", "rule", "blocked", "label", *NUMBERS), "urls")
    model = fit(rows, **options)
    if model is None:
        scored = rows.withColumn("p_block", F.lit(0.0))
    else:
        told = model.transform(VectorAssembler(inputCols=list(NUMBERS), outputCol="features").transform(rows))
        scored = told.withColumn("p_block", vector_to_array("probability")[1])
    block = F.coalesce("blocked", F.col("p_block") >= 0.5)
    return scored.select(
        "page_id", "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("p_block")).alias("p_block"),
    )
