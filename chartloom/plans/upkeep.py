"""A standing index that takes inserts, replacements and deletes without a rebuild (FTS-08, FTS-09, VEC-05, ING-13).

Every change is a segment: what it adds, which ids it takes away (tombstones),
and signed term and document counts, so that the corpus statistics stay those
of the documents there are.  A reader takes the segments that the signpost names
and leaves out rows that a later segment took away.  Segments are never changed:
a change writes its own and then replaces the signpost.  When there are many
segments, or many dead rows, ``merge`` writes fewer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.config import SETTINGS
from chartloom.operators import fulltext
from chartloom.plans.retrieval import Corpus
from chartloom.sources import versions

#: ``upkeep`` merges beyond so many segments, and all of them once the later ones hold this part of the documents.
MAX_SEGMENTS = 8
REWRITE_PART = 0.25
#: So many ids of a change are compared as a list that reaches the scan of the stored chunks; of more the stored counts are taken.
LISTED_IDS = 1000
#: So many ids at most are broadcast to the rows they take away (about 40 bytes each).
BROADCAST_IDS = 1_000_000
#: Segments stay, and a merge has them twice for a while.
CODEC = "zstd"
_SIGNPOST = "segments array<struct<seq: int, folder: string, rows: bigint>>, next int, stem boolean, fields map<string, double>"


def _by_id(chunks: DataFrame) -> DataFrame:
    """Sorted by id in each file, so that a reader of few ids skips row groups and pages.  Few rows are dealt by id over the cores; many are written where they are read, for no text is shuffled."""
    few = chunks.count() <= fulltext.TASK_DOCS * chunks.sparkSession.sparkContext.defaultParallelism
    return (chunks.repartitionByRange("chunk_id") if few else chunks).sortWithinPartitions("chunk_id")


def _store(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", CODEC).parquet(path)


@dataclass
class LiveIndex:
    spark: SparkSession
    path: str

    # Reading

    def _state(self):
        return versions.current(self.spark, self.path)

    def _table(self, name: str, segments) -> DataFrame:
        """A table of all given segments, with the segment's number."""
        parts = [self.spark.read.parquet(f"{self.path}/{s['folder']}/{name}").withColumn("seq", F.lit(s["seq"])) for s in segments]
        return reduce(DataFrame.unionByName, parts)

    def _living(self, name: str, segments, key: str, order: str | None = None) -> DataFrame:
        """Rows that no later segment took away; the newest segment's need no look.

        They come as they lie in their files; where the rows had to be shuffled,
        because very many ids were taken away, they are sorted by ``order`` again.
        """
        older = self._table(name, segments)
        if len(segments) == 1:
            return older
        taken = self._table("gone", segments[1:])
        gone = taken.groupBy("id").agg(F.max("seq").alias("gone_seq"))
        few = taken.count() <= BROADCAST_IDS
        living = older.join(F.broadcast(gone) if few else gone, (F.col(key) == F.col("id")) & (F.col("seq") < F.col("gone_seq")), "left_anti")
        return living if few or order is None else living.sortWithinPartitions(order)

    def open(self) -> Corpus:
        """The documents there are, as chunks, vectors and text index."""
        state = self._state()
        s = state["segments"]
        stats = self._table("stats", s).agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
        frequencies = self._table("frequencies", s).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        text = fulltext.TextIndex(
            self._living("postings", s, "doc_id").drop("seq"), self._living("lengths", s, "doc_id").drop("seq"), frequencies,
            stats.select("n_docs", (F.col("words") / F.nullif(F.col("n_docs"), F.lit(0))).alias("avg_length")), state["stem"],
        )
        return Corpus(self._living("chunks", s, "chunk_id").drop("seq"), self._living("vectors", s, "chunk_id").drop("seq"), text)

    # Changing

    @staticmethod
    def create(spark: SparkSession, path: str, chunks: DataFrame, vectors: DataFrame, fields: dict[str, float] | None = None, stem: bool = False) -> LiveIndex:
        """A new index; ``chunks`` has chunk_id, patient_id and the fields, ``vectors`` chunk_id and embedding.  Of rows with one id the first by content stays."""
        index = LiveIndex(spark, path)
        fields = dict(SETTINGS.field_weights) if fields is None else fields
        first = index._segment([], 0, chunks, vectors, None, fields, stem)
        versions.publish(spark, path, _SIGNPOST, ([first], 1, stem, fields))
        return index

    def put(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """Insert documents; those whose id is there already are replaced, with their vectors."""
        self._change(chunks, vectors, chunks.select(F.col("chunk_id").alias("id")).distinct())

    def delete(self, ids: DataFrame, key: str = "chunk_id") -> None:
        """Delete documents by id, or by another column of the chunks (``patient_id``: a cascade); unknown ones are ignored."""
        if key != "chunk_id":
            state = self._state()
            ids = self._living("chunks", state["segments"], "chunk_id").join(ids.select(key).distinct(), key, "left_semi").select("chunk_id")
        self._change(None, None, ids.select(F.col("chunk_id").alias("id")).distinct())

    def _change(self, chunks: DataFrame | None, vectors: DataFrame | None, gone: DataFrame) -> None:
        state = self._state()
        new = self._segment(state["segments"], state["next"], chunks, vectors, gone, state["fields"], state["stem"])
        versions.publish(self.spark, self.path, _SIGNPOST, ([*state["segments"], new], state["next"] + 1, state["stem"], state["fields"]))

    def _segment(self, older, seq: int, chunks: DataFrame | None, vectors: DataFrame | None, gone: DataFrame | None, fields, stem: bool) -> tuple:
        """Write a segment: what is added, what goes, and the counts of both."""
        folder = versions.fresh("segment")
        at = f"{self.path}/{folder}"
        if chunks is None:
            chunks, vectors = (self._table(n, older[:1]).drop("seq").limit(0) for n in ("chunks", "vectors"))
        _store(_by_id(fulltext.one_each(chunks, "chunk_id", *fields)), f"{at}/chunks")
        added = self.spark.read.parquet(f"{at}/chunks")
        _store(vectors.join(added.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]), f"{at}/vectors")
        gone = added.select(F.col("chunk_id").alias("id")).limit(0) if gone is None else gone
        _store(gone, f"{at}/gone")
        index = fulltext.build(added, fields, stem=stem)
        # A file holds the postings of one task's documents by term; all of a term in one file would be a shuffle of every posting.
        _store(index.postings.sortWithinPartitions("term"), f"{at}/postings")
        _store(index.lengths, f"{at}/lengths")
        added_terms = self.spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        lengths = self.spark.read.parquet(f"{at}/lengths")
        stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
        if older:
            postings, lengths_gone = self._dropped(older, self.spark.read.parquet(f"{at}/gone"), fields, stem)
            added_terms = added_terms.unionAll(postings.groupBy("term").agg((-F.count(F.lit(1))).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")
            minus = lengths_gone.agg((-F.count(F.lit(1))).alias("n_docs"), (-F.coalesce(F.sum("length"), F.lit(0))).alias("words"))
            stats = stats.unionAll(minus).agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
        _store(added_terms, f"{at}/frequencies")
        _store(stats, f"{at}/stats")
        return seq, folder, lengths.count()

    def _dropped(self, segments, gone: DataFrame, fields, stem: bool) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of the living documents with the ids of ``gone``.

        A short list of ids reaches the scan of the chunks, which skips the row
        groups without them, and their texts are split; of more the stored rows are
        taken, and no text is read.
        """
        if gone.limit(LISTED_IDS + 1).count() <= LISTED_IDS:
            index = fulltext.build(self._stored_chunks(segments, gone), fields, stem=stem)
            return index.postings, index.lengths
        ids = gone.withColumnRenamed("id", "doc_id")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return tuple(self._living(name, segments, "doc_id").join(ids, "doc_id", "left_semi") for name in ("postings", "lengths"))

    def _stored_chunks(self, segments, gone: DataFrame) -> DataFrame:
        """The living chunks with the ids of ``gone``.  A short list of ids reaches the scan, which skips the row groups without them."""
        chunks = self._living("chunks", segments, "chunk_id")
        few = [r["id"] for r in gone.limit(LISTED_IDS + 1).collect()]
        if len(few) <= LISTED_IDS:
            return chunks.where(F.col("chunk_id").isin(few)).drop("seq")
        return chunks.join(gone.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi").drop("seq")

    # Upkeep

    def upkeep(self) -> bool:
        """Merge if there are too many segments: the later ones into one, or all when these hold much; tells whether it did."""
        s = self._state()["segments"]
        if len(s) <= MAX_SEGMENTS:
            return False
        later = sum(x["rows"] for x in s[1:])
        self.merge(0 if later > REWRITE_PART * max(s[0]["rows"], 1) else 1)
        return True

    def merge(self, first: int = 0) -> None:
        """Write the segments from number ``first`` on as one.  No text is split again, and no text or posting is shuffled: living rows are copied in the order they lie in, and signed counts added."""
        state = self._state()
        s = state["segments"]
        kept, merged = s[:first], s[first:]
        folder = versions.fresh("segment")
        at = f"{self.path}/{folder}"
        for name, key, order in (("chunks", "chunk_id", "chunk_id"), ("vectors", "chunk_id", None), ("postings", "doc_id", "term"), ("lengths", "doc_id", None)):
            _store(self._living(name, merged, key, order).drop("seq"), f"{at}/{name}")
        gone = self._table("gone", merged).select("id").distinct()
        _store(gone if kept else gone.limit(0), f"{at}/gone")
        _store(self._table("frequencies", merged).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0"), f"{at}/frequencies")
        _store(self._table("stats", merged).agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words")), f"{at}/stats")
        rows = self.spark.read.parquet(f"{at}/lengths").count()
        versions.publish(self.spark, self.path, _SIGNPOST, ([*kept, (merged[-1]["seq"], folder, rows)], state["next"], state["stem"], state["fields"]))

    def drop_old(self) -> int:
        """Delete segments that the signpost no longer names, once no search uses them; returns how many."""
        named = {x["folder"] for x in self._state()["segments"]} | {versions.SIGNPOST}
        old = [f for f in versions.folders(self.spark, self.path) if f not in named]
        for f in old:
            versions.delete(self.spark, f"{self.path}/{f}")
        return len(old)

