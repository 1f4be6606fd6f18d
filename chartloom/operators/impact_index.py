"""BM25 top k with early termination over postings ordered by impact (FTS-05, FTS-07).

A posting's impact is all of its score but the term's weight in the query.  The
postings of a term lie by impact level, highest first; ``heads`` has each
level's size and greatest impact.  A search reads

1. for queries all of whose terms exist, the two rarest terms' postings, and
   probes the documents in both for the rest: a document with every term is first
   choice, so most queries end here;
2. for the others, the highest levels of each term, whose best documents give a
   score that the k-th result has at least;
3. the postings of the terms that a document needs one of to reach that score,
   level by level, but for levels too low to matter;
4. the other terms' postings of the documents found, the strongest terms first,
   dropping documents that can no longer reach the score.

The results are those of ``fulltext.search`` without scopes.  Everything that
grows with the corpus is a join or an aggregate; no sort by term puts a frequent
term's postings into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.config import SETTINGS
from chartloom.operators import fulltext
from chartloom.sources import versions

LEVELS = 64
#: The first guess reads the highest levels of a term until they have so many postings.
FIRST_POSTINGS = 64
#: The terms that are probed only are taken in so many rounds.
ROUNDS = 3


@dataclass
class ImpactIndex:
    postings: DataFrame  # term, level, doc_id, impact, sorted by term and level
    heads: DataFrame  # term, level, top, n
    n_docs: DataFrame  # one row
    stem: bool = False

    @staticmethod
    def build(index: fulltext.TextIndex, path: str) -> ImpactIndex:
        """Write the postings of an index by impact; a rebuilt or merged index needs a new one, as impacts depend on the mean length."""
        s, f = SETTINGS, F.col("weight")
        whole = index.sized().crossJoin(index.stats)  # the statistics are one row
        impact = f * (s.bm25_k1 + 1) / (f + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("length") / F.col("avg_length")))
        # No impact reaches k1 + 1; level 0 is the highest.
        level = F.least(F.floor((1 - F.col("impact") / (s.bm25_k1 + 1)) * LEVELS), F.lit(LEVELS - 1)).cast("int")
        rows = whole.select("term", "doc_id", impact.alias("impact")).withColumn("level", level)
        rows.repartitionByRange("term", "level", "doc_id").sortWithinPartitions("term", "level", "doc_id").write.parquet(f"{path}/postings")
        spark = rows.sparkSession
        heads = spark.read.parquet(f"{path}/postings").groupBy("term", "level").agg(F.max("impact").alias("top"), F.count(F.lit(1)).alias("n"))
        heads.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/heads")
        index.stats.select("n_docs").write.parquet(f"{path}/n_docs")
        return ImpactIndex.load(spark, path, index.stem)

    @staticmethod
    def load(spark: SparkSession, path: str, stem: bool = False) -> ImpactIndex:
        return ImpactIndex(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "heads", "n_docs")], stem=stem)


@dataclass
class Found:
    """``results`` (query_id, doc_id, score, rank), and ``reads`` (query_id, step, postings) of what was read for them."""

    results: DataFrame
    reads: DataFrame


class _Search:
    """One search; tables between the steps are written to the shared folder, so that no step is computed twice."""

    def __init__(self, index: ImpactIndex, queries: DataFrame, k: int, digits: int | None) -> None:
        self.index, self.k, self.slack = index, k, 10.0 ** -(9 if digits is None else digits)
        self.folder, self.made, self.reads = versions.scratch(queries.sparkSession, "impact-search"), 0, []
        terms = fulltext.query_terms(queries, index.stem)
        asked = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
        self.heads = self.keep(index.heads.join(asked.select("term").distinct(), "term", "left_semi"))
        idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        df = self.heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top")).crossJoin(index.n_docs)  # one row
        weight = F.col("times") * F.when(idf > 0, idf).otherwise(SETTINGS.idf_floor)
        #: (query_id, term, weight, df, bound, n_terms): what the term gives a document at most.
        self.rated = self.keep(asked.join(df, "term").select("query_id", "term", weight.alias("weight"), "df", (weight * F.col("top")).alias("bound"), "n_terms"))

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        return versions.stored(df, f"{self.folder}/{self.made}")

    def read(self, step: str, wanted: DataFrame, on: list[str]) -> DataFrame:
        """(query_id, doc_id, part, matched): the sums over the postings that ``wanted`` (query_id, ``on``, weight) asks for."""
        found = self.index.postings.join(wanted, on).groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("part"), F.count(F.lit(1)).alias("matched"))
        found = self.keep(found)
        self.reads.append(found.groupBy("query_id").agg(F.sum("matched").alias("postings")).withColumn("step", F.lit(step)))
        return found

    def probe(self, step: str, docs: DataFrame, terms: DataFrame) -> DataFrame:
        """``docs`` (query_id, doc_id, part, matched) with the parts of further terms (query_id, term, weight) added."""
        wanted = docs.select("query_id", "doc_id").join(terms.select("query_id", "term", "weight"), "query_id")
        more = self.read(step, wanted, ["term", "doc_id"]).withColumnsRenamed({"part": "__part", "matched": "__matched"})
        both = docs.join(more, ["query_id", "doc_id"], "left")
        return both.select("query_id", "doc_id", (F.col("part") + F.coalesce("__part", F.lit(0.0))).alias("part"), (F.col("matched") + F.coalesce("__matched", F.lit(0))).alias("matched"))

    def complete(self) -> DataFrame:
        """(query_id, doc_id, part) of the documents that have every term of their query."""
        whole = self.rated.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where("n = n_terms")
        ranked = whole.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term")))
        rare = self.read("rare", ranked.where("place <= 2").select("query_id", "term", "weight"), ["term"])
        sizes = whole.select("query_id", "n_terms").distinct()
        both = rare.join(sizes, "query_id").where(F.col("matched") == F.least(F.col("n_terms"), F.lit(2))).drop("n_terms")
        every = self.probe("complete", both, ranked.where("place > 2")).join(sizes, "query_id")
        return self.keep(every.where("matched = n_terms").select("query_id", "doc_id", "part"))

    def least(self, rated: DataFrame) -> DataFrame:
        """(query_id, least): a score that the query's k-th document reaches, 0 if the highest levels have fewer documents."""
        above = F.sum("n").over(Window.partitionBy("query_id", "term").orderBy("level").rowsBetween(Window.unboundedPreceding, -1))
        levels = rated.join(self.heads, "term").withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < FIRST_POSTINGS)
        first = self.read("first", levels.select("query_id", "term", "level", "weight"), ["term", "level"])
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "doc_id"))
        some = first.withColumn("place", best).where(F.col("place") <= 2 * self.k).select("query_id", "doc_id", F.lit(0.0).alias("part"), F.lit(0).cast("bigint").alias("matched"))
        exact = self.probe("first", some, rated)
        return self.keep(rated.select("query_id").distinct().join(self.kth(exact), "query_id", "left").select("query_id", F.coalesce("least", F.lit(0.0)).alias("least")))

    def kth(self, docs: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "doc_id"))
        return docs.withColumn("place", place).where(F.col("place") == self.k).select("query_id", F.col("part").alias("least"))

    def any_term(self, rated: DataFrame) -> DataFrame:
        """(query_id, doc_id, part) of all documents that can be among the k best; their parts are whole scores."""
        below = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "term"))
        total = F.sum("bound").over(Window.partitionBy("query_id"))
        ordered = self.keep(rated.join(self.least(rated), "query_id").withColumn("upto", below).withColumn("total", total).withColumn("needed", F.col("upto") >= F.col("least") - self.slack))
        needed = ordered.where("needed").join(self.heads, "term").where(F.col("weight") * F.col("top") + F.col("total") - F.col("bound") >= F.col("least") - self.slack)
        docs = self.read("needed", needed.select("query_id", "term", "level", "weight"), ["term", "level"])
        rest = ordered.where("not needed")
        size, place = F.count(F.lit(1)).over(Window.partitionBy("query_id")), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("term")))
        rest = self.keep(rest.withColumn("round", F.ceil(place * ROUNDS / size).cast("int")))
        least = ordered.select("query_id", "least").distinct()
        for number in range(ROUNDS + 1):
            if number:
                docs = self.keep(self.probe(f"round {number}", docs, rest.where(F.col("round") == number)))
                least = least.join(self.kth(docs).withColumnRenamed("least", "now"), "query_id", "left").select("query_id", F.greatest("least", F.coalesce("now", F.lit(0.0))).alias("least"))
            to_come = rest.where(F.col("round") > number).groupBy("query_id").agg(F.sum("bound").alias("more"))
            limits = least.join(to_come, "query_id", "left").select("query_id", (F.col("least") - F.coalesce("more", F.lit(0.0)) - self.slack).alias("limit"))
            docs = self.keep(docs.join(limits, "query_id").where(F.col("part") >= F.col("limit")).drop("limit"))
        return docs.select("query_id", "doc_id", "part")


def search(index: ImpactIndex, queries: DataFrame, k: int = SETTINGS.top_k, digits: int | None = None) -> Found:
    """What ``fulltext.search`` finds for the queries (query_id, text), with far fewer postings read."""
    s = _Search(index, queries, k, digits)
    complete = s.complete()
    other = s.keep(s.rated.join(complete.select("query_id").distinct(), "query_id", "left_anti"))
    scored = complete.unionByName(s.any_term(other))
    score: Column = -F.col("part")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "doc_id"))
    results = scored.select("query_id", "doc_id", (score if digits is None else F.round(score, digits)).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
    reads = s.reads[0]
    for more in s.reads[1:]:
        reads = reads.unionByName(more)
    return Found(results, reads.select("query_id", "step", "postings"))


def all_postings(index: ImpactIndex, queries: DataFrame) -> DataFrame:
    """(query_id, postings): those of all its terms, which a search without early termination reads."""
    terms = fulltext.query_terms(queries, index.stem).distinct().select("query_id", "term").distinct()
    return terms.join(index.heads.groupBy("term").agg(F.sum("n").alias("n")), "term").groupBy("query_id").agg(F.sum("n").alias("postings"))
