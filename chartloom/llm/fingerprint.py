"""One-permutation MinHash fingerprints, in DataFrame functions only.

A text's five-word shingles are hashed once.  The top bits of a hash choose one
of 128 bins and each bin keeps its least hash.  An empty bin copies from a
filled one: every bin probes its own pseudo-random sequence of bins and takes
the first filled one (optimal densification).  After PROBES misses it takes the
filled bin that comes first in its own pseudo-random order of all bins.  The fingerprint is the low
eight bits of every bin's value.  Two equal low parts may come from different
values, so the share of equal bins is corrected for chance.

Words are split at white space.  Fewer than five words make one shingle; a text
without words has the shingle of the empty string.  Equal texts have equal
fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm import store

BINS, BITS, WORDS = 128, 8, 5
PROBES = 16
_SHIFT = 64 - (BINS.bit_length() - 1)


def _let(value, body):
    """``body(value)`` with ``value`` evaluated once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text):
    """Sorted 64-bit hashes of the five-word shingles."""
    words = F.array_remove(F.split(text, r"\s+"), "")

    def shingles(h):
        five = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
        return F.when(F.size(h) >= WORDS, five).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array(F.xxhash64(F.lit(""))))

    return F.sort_array(_let(F.transform(words, lambda w: F.xxhash64(w)), shingles))


def _bin(x):
    return F.shiftrightunsigned(x, _SHIFT)


def codes(text):
    """The low bits of the 128 bins, as an array of smallint."""

    def low(x):
        return x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint")

    every = F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint"))

    def densify(least):
        def own(filled):
            return F.transform(every, lambda b: F.get(least, F.array_position(filled, b).cast("int") - 1))

        def borrow(values):
            def code(b):
                probes = [F.get(values, F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
                last = F.array_min(F.transform(least, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("o"), x.alias("x"))))["x"]
                return low(F.coalesce(F.get(values, b.cast("int")), *probes, last))

            return F.transform(every, code)

        return _let(_let(F.transform(least, _bin), own), borrow)

    def firsts(h):
        return F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, F.greatest(i - 1, F.lit(0))))))

    return _let(shingle_hashes(text), lambda h: _let(firsts(h), densify))


def packed(code):
    """Hexadecimal form of a fingerprint: two digits a bin."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def likeness(a, b):
    """Jaccard estimate from two fingerprints, corrected for chance matches; 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def fingerprint(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds ``fingerprint_codes``, replacing a column of that name; null texts count as empty."""
    return docs.withColumn("fingerprint_codes", codes(store.text_of(text_column)))


#: A task of ``with_next`` is meant to read about this many bytes of text, in ranges of keys of a fourth of that.
TASK_BYTES = 32 << 20
RANGES = 4


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", derived: dict | None = None) -> DataFrame:
    """Adds ``next_<column>``: the value in the next document by descending key; the last's next is the first.

    ``derived`` columns are made from ``columns`` once a document, and have a next as well.

    Documents are dealt into ranges of keys, whose number follows the bytes in
    ``columns``.  Each range gets a guest, a copy of the first document of the
    range after it, so that every document finds its next in its own range: no
    global sort and one exchange.  Equal keys are ordered by row hash; null keys
    come last.  Columns named as an output are replaced.
    """
    spark = docs.sparkSession
    added = [f"next_{c}" for c in (*columns, *(derived or ()))]
    docs = docs.select(*store.others(docs, *added, "__b", "__top", "__from", "__first", "__guest", "__tie"))
    size = sum((F.coalesce(F.length(F.col(c).cast("binary")), F.lit(0)) if docs.schema[c].dataType.simpleString() == "string" else F.lit(8) for c in columns), F.lit(8))
    lo, hi, total, total_bytes = docs.agg(F.min(key), F.max(key), F.count(F.lit(1)), F.sum(size.cast("bigint"))).first()
    tasks = max(store.width(spark), -(-int(total_bytes or 0) // TASK_BYTES))
    n = RANGES * tasks
    if lo is None:
        lo = hi = 0

    def top_of(bucket) -> DataFrame:
        return store.materialize(docs.groupBy(bucket.cast("bigint").alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("__top")), "ranges")

    bucket = F.coalesce(F.width_bucket(F.col(key).cast("double"), F.lit(float(lo)), F.lit(float(hi) + 1), F.lit(n)), F.lit(0)) if hi > lo else F.when(F.col(key).isNull(), 0).otherwise(1)
    ranges = top_of(bucket)
    most, count = ranges.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    if most > max(8 * total / max(count, 1), 10_000):  # keys lie unevenly: ranges of about equal counts
        n = min(n, 4_000)
        cuts = sorted({c for c in docs.select(F.percentile_approx(key, [i / n for i in range(1, n)])).first()[0] or []})
        bucket = F.when(F.col(key).isNull(), 0).otherwise(1 + F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))))
        ranges = top_of(bucket)
    table = docs.withColumn("__b", bucket.cast("bigint"))
    # The range that follows each, in descending order; the last is followed by the first.  One row a range.
    down = Window.orderBy(F.desc("__b"))
    links = ranges.select("__b", F.coalesce(F.lead("__b").over(down), F.max("__b").over(Window.partitionBy(F.lit(0)))).alias("__from"))
    order = [F.col("__guest"), F.desc_nulls_last(key), F.col("__tie")]
    keep = [key, *columns]
    # The first documents of the ranges, at most one a range.
    tops = ranges.select(F.col("__b").alias("__of"), "__top")
    firsts = table.select("__b", *keep).join(tops, (F.col("__b") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__top"))).select("__b", *keep)
    firsts = firsts.withColumn("__tie", F.xxhash64(*keep)).groupBy("__b").agg(F.min_by(F.struct(*keep), "__tie").alias("__first")).withColumnRenamed("__b", "__from")
    guests = firsts.join(links, "__from").select("__b", F.lit(1).alias("__guest"), F.lit(0).cast("bigint").alias("__tie"), "__first.*")
    rows = table.select("*", F.lit(0).alias("__guest"), F.xxhash64(*keep).alias("__tie"))
    # Derived on either side of the union: the search for the first documents reads no derived column.
    everyone = rows.withColumns(derived or {}).unionByName(guests.withColumns(derived or {}), allowMissingColumns=True)
    w = Window.partitionBy("__b").orderBy(*order)
    out = everyone.repartition(tasks, "__b").select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (*columns, *(derived or ()))])
    return out.where("__guest = 0").drop("__b", "__guest", "__tie")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir, "doc_id", "text").withColumn("text", store.text_of())
    linked = with_next(docs, ["text"], derived={"fingerprint_codes": codes(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    linked = linked.select("doc_id", n.cast("bigint").alias("n_chars"), "fingerprint_codes", "next_fingerprint_codes", edited.alias("edited"))
    linked = linked.withColumn("edited_codes", codes(F.col("edited")))
    return linked.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("fingerprint_codes")).alias("fingerprint"), packed(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint_codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("fingerprint_codes"), F.col("next_fingerprint_codes")).alias("near_next"),
    )
