"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become pieces of at most ``capacity`` tokens.  How many pieces have
each length is all that packing depends on, so the plan is made from that
histogram (``capacity`` numbers, whatever the corpus holds): pieces above a
third of the capacity are matched greedily, longest first with the longest
that still fits, at most two a sequence; shorter pieces then go, longest
first, into the tightest gap.  The plan is a list of runs: the pieces of one
length with ranks from..to fill known places.  A piece finds its rank from its
place in its own partition and the counts of the partitions before.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm import store
from chartloom.llm.tokens import HFTokenizer, load, vocabulary_path

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, nth bigint"


@dataclass
class Plan:
    """Sorted runs: ranks >= ``rank`` of ``length`` go, ``per`` a sequence, to ``sequence``.. at ``offset``.."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 44 | self.rank
        run = np.searchsorted(key, length << 44 | rank, "right") - 1
        k = rank - self.rank[run]
        return self.sequence[run] + k // self.per[run], self.offset[run] + k % self.per[run] * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Packing plan of ``histogram[length]`` pieces; lengths are 1..capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap -> (first sequence, how many)
    open_gaps: list[int] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        runs.append((length, int(used[length]), sequence, per, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((sequence, n))

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b > third and not (left[b] > 1 if b == a else left[b]):
                b -= 1
            if b <= third:
                n = int(left[a])
                put(a, n, sequences, 1, 0)
                leave(capacity - a, sequences, n)
            else:
                n = int(left[a] // 2 if a == b else min(left[a], left[b]))
                put(a, n, sequences, 1, 0)
                put(b, n, sequences, 1, a)
                leave(capacity - a - b, sequences, n)
            sequences += n
    for a in range(third, 0, -1):
        while left[a]:
            fits = next((g for g in open_gaps if g >= a), 0)
            if not fits:
                n = int(-(-left[a] // (capacity // a)))
                leave(capacity, sequences, n)
                sequences += n
                continue
            first, n = gaps[fits].pop()
            if not gaps[fits]:
                open_gaps.remove(fits)
            per = fits // a
            full = int(min(n, left[a] // per))
            rest = int(min(left[a] - full * per, per)) if full < n else 0
            if full:
                put(a, full * per, first, per, capacity - fits)
                leave(fits - per * a, first, full)
            if rest:
                put(a, rest, first + full, per, capacity - fits)
                leave(fits - rest * a, first + full, 1)
            leave(fits, first + full + bool(rest), n - full - bool(rest))
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    return Plan(*table.T, n_sequences=sequences)


def _cutter(path: str, capacity: int, end_id: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tokenizer = load(HFTokenizer, path, "space")
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(b.column(0).to_pylist(), tokenizer.ids(b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = 0
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    n = end - at
                    for c, v in zip(cols, (doc_id, piece, at, n, ids[at:end].tobytes(), seen[n])):
                        c.append(v)
                    seen[n] += 1
                    at = end
            doc, piece, start, length, raw, nth = cols
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "part", "nth"],
            )

    return run


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces with their ids, written once to the shared folder.

    A document is its token ids and ``end_id`` (null text: ``end_id`` alone).
    Only longer ones are cut, into pieces of ``capacity``; the first is shorter.
    ``part`` and ``nth`` number the pieces of one length within a task.  Equal
    rows give equal pieces, each in a place of its own; null ids stay null; an
    empty table gives no piece.
    """
    store.small_batches(docs.sparkSession)
    path = tokenizer or vocabulary_path("byte_bpe_50k.json")
    pieces = docs.select(F.col(id_column).cast("bigint"), store.text_of(text_column)).mapInArrow(_cutter(path, capacity, end_id), PIECES)
    return store.materialize(pieces, "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; other columns stay, but for ones of these two names.

    ``pieces`` needs length, part and nth as ``cut`` gives them; drop what is
    not needed before the call, as rows may be shuffled: the counts before each
    task, at most ``capacity`` rows a task, are broadcast while Spark measures
    them below its own limit, and joined by a shuffle beyond.  Among pieces of
    one length the order is that of tasks and rows.
    """
    per_part = store.materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    made = plan(histogram, capacity)
    before = per_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("__before"))
    columns = store.others(pieces, "part", "nth", "sequence_id", "offset")
    ranked = pieces.join(before, ["length", "part"]).select(*columns, (F.col("__before") + F.col("nth")).alias("__rank"))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length, rank):
        import pandas as pd

        sequence, offset = made.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("__at", place("length", "__rank")).select(*columns, "__at.sequence_id", "__at.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut(store.documents(spark, sf_dir, "doc_id", "text"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth"))
