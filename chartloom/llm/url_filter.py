"""URL filtering by fixed rules and by mined association rules.

Fixed host and path rules decide first, the longest that fits.  Other URLs are
judged by rules mined from labelled ones: FP-growth finds token combinations
that occur with a verdict often enough (support) and almost only with it
(confidence).  At judging time an inverted index from each rule's rarest token
gives the rules that can apply; the most confident that does apply decides.

Tokens below the support are in no rule, and tokens that occur in the very same
URLs can stand for one another in any rule: both leave the baskets before they
are mined, so that many tokens that always come together are one item and not
all their combinations.  At judging time a url with any token of such a class
has the item.  What remains is exponential only in the tokens of one url that
are frequent and occur in different sets of URLs.

Repeated rows count as often as they occur, and equal urls get equal verdicts.
"""

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import store

#: Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
#: A rule of the query holds in so many labelled rows at least: with fewer, even one without an exception has a
#: confidence that may be under MIN_CONFIDENCE (the lower Wilson bound n / (n + z^2), z = 1.64 for 95 % on one side).
LEAST_ROWS = math.ceil(1.64**2 * MIN_CONFIDENCE / (1 - MIN_CONFIDENCE))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host, path, rules=RULES):
    """The longest fitting rule's text, or null: a rule's host fits itself and its subdomains."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        name = rule[:at]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens_of(url):
    """Distinct tokens: host labels, path segments and query keys; digits are generalised to #."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))

    def part(tag, text, cut):
        words = F.filter(F.split(text, cut), lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(tag), F.regexp_replace(F.lower(w), "[0-9]+", "#")))

    keys = F.transform(F.split(query, "&"), lambda pair: F.substring_index(pair, "=", 1))
    return F.array_distinct(F.concat(part("h:", host, r"\."), part("p:", path, "/"), part("q:", F.array_join(keys, "&"), "&")))


@dataclass
class Rule:
    """A verdict for urls that have a token of each of ``tokens``, every one of which stands for its class."""

    tokens: frozenset
    block: bool
    confidence: float
    support: float


class Rules(list):
    """Rules, most confident first, and ``item_of``: the item of each token that is not its own."""

    def __init__(self, rules=(), item_of: dict[str, str] | None = None) -> None:
        super().__init__(rules)
        self.item_of = item_of or {}

    def items(self, tokens) -> set[str]:
        return {self.item_of.get(t, t) for t in tokens}


def token_classes(baskets: DataFrame, least: float) -> DataFrame:
    """(token, item) of the tokens in at least ``least`` rows of (row, items): the item is the first token of those in the same rows.

    Row sets are compared by size and two sums of row hashes.  At most rows x
    tokens a row / least tokens remain, whatever the number of rows.
    """
    row = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(20,0)")).alias(f"sum{k}") for k in (1, 2)]
    sets = baskets.select("row", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *row).where(F.col("n") >= least)
    same = sets.groupBy("n", "sum1", "sum2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return same.select(F.explode("tokens").alias("token"), "item")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least_rows: int = 1) -> Rules:
    """Rules from (url, block) rows, most confident first.  Rows with a null url or label are ignored; no rows, no rules.

    Every rule over support and confidence counts that holds in ``least_rows``
    rows; where there are few labels this keeps the combinations of a single
    url's tokens from all being frequent.  One that holds all items of
    an earlier rule can never decide and is left out as it is read.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    known = labelled.where("url is not null and block is not null")
    baskets = store.materialize(known.select(F.monotonically_increasing_id().alias("row"), F.filter(tokens_of(F.col("url")), lambda t: t != "h:www").alias("items"), "block"), "baskets")
    total = baskets.count()
    if total < max(least_rows, 1):
        return Rules()
    min_support = max(min_support, least_rows / total)
    classes = store.materialize(token_classes(baskets, min_support * total), "token-classes")
    item_of = {r["token"]: r["item"] for r in classes.collect()}  # bounded by tokens a url / min_support
    mapping = spark.createDataFrame(sorted(item_of.items()), "token string, item string")
    own = baskets.select("row", F.explode("items").alias("token")).join(F.broadcast(mapping), "token").groupBy("row").agg(F.collect_set("item").alias("own"))
    label = F.when(F.col("block"), "=block").otherwise("=allow")
    items = store.materialize(baskets.join(own, "row", "left").select(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(label)).alias("items")), "items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=4 * store.width(spark)).fit(items)
    wanted = F.col("consequent")[0].isin("=block", "=allow") & (F.size("antecedent") > 0)
    found = model.associationRules.where(wanted).select(F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("label"), "confidence", "support")
    ranked = found.orderBy(F.desc("confidence"), F.desc("support"), F.size("tokens"), F.array_join("tokens", " "))
    kept: list[Rule] = []
    by_least: dict[str, list[frozenset]] = {}
    for r in ranked.toLocalIterator():
        tokens = frozenset(r["tokens"])
        if not any(t <= tokens for x in tokens for t in by_least.get(x, ())):
            by_least.setdefault(min(tokens), []).append(tokens)
            kept.append(Rule(tokens, r["label"] == "=block", r["confidence"], r["support"]))
    return Rules(kept, {t: i for t, i in item_of.items() if t != i})


class RuleIndex:
    """Rules by their rarest token (the one in fewest rules)."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules if isinstance(rules, Rules) else Rules(rules)
        uses: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                uses[t] = uses.get(t, 0) + 1
        self.by_token: dict[str, list[tuple[int, Rule]]] = {}
        for rank, r in enumerate(rules):
            anchor = min(r.tokens, key=lambda t: (uses[t], t))
            self.by_token.setdefault(anchor, []).append((rank, r))

    def judge(self, tokens) -> bool | None:
        """The verdict of the most confident rule whose tokens all occur; None where none does."""
        have, best, verdict = self.rules.items(tokens), None, None
        for t in have:
            for rank, r in self.by_token.get(t, ()):
                if best is not None and rank > best:
                    break
                if r.tokens <= have:
                    best, verdict = rank, r.block
                    break
        return verdict


def judge(pages: DataFrame, rules: list[Rule], url_column: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict.

    Null urls and those without "://" have empty host and path, and are allowed;
    so is a url that no fixed or mined rule covers.  Equal rows get equal
    results, an empty table an empty one; columns named as the four results are
    replaced by them.
    """
    index = pages.sparkSession.sparkContext.broadcast(RuleIndex(rules))  # their number follows the support, a share of the labels, not the input

    @F.pandas_udf("boolean")
    def mined(tokens: pd.Series) -> pd.Series:
        return pd.Series([index.value.judge(t) for t in tokens], dtype="boolean")

    url = F.col(url_column)
    host, path = host_of(url), path_of(url)
    fixed = fixed_rule(host, path)
    blocks = F.lit(False)
    for rule, verdict in RULES:
        blocks = F.when(fixed == rule, F.lit(verdict == "block")).otherwise(blocks)
    block = F.when(F.col("rule").isNotNull(), F.col("__fixed")).otherwise(F.coalesce(F.col("__mined"), F.lit(False)))
    keep = store.others(pages, "host", "path", "rule", "verdict")
    judged = pages.select(F.struct(*keep).alias("__row"), host.alias("host"), path.alias("path"), fixed.alias("rule"), blocks.alias("__fixed"), mined(tokens_of(url)).alias("__mined"))
    return judged.select(*[F.col("__row")[c].alias(c) for c in keep], "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"))


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the labels row of its id: toxic or of poor quality means block."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block"))
    return pages.join(labels, "page_id").select("url", "block")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, mine(labelled_pages(spark, sf_dir), least_rows=LEAST_ROWS)).select("page_id", "host", "path", "rule", "verdict")
