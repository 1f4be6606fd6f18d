"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are compared by their sets of five-word shingles; a link is a pair of
documents with Jaccard similarity of at least THRESHOLD.

1. Equal texts form a class; only its first document (least id) goes on.
2. Each of TREES trees is a prefix trie of signatures of DEPTH MinHash values.  A
   trie node is known by its tree and prefix, and its members are candidates.
3. Prefixes start at their full depth and are shortened a value at a time.  The
   pairs that part at a depth in every tree are compared in the round of the
   deepest node that they share, so no pair is compared in two rounds.  After a
   round every link found, of similarity s, stands for 1 / P(s) links, P(s) = 1 -
   (1 - s^depth)^TREES being the chance to find it at this depth.  Shortening
   ends when the links found are RECALL of those estimated (less three standard
   deviations), or at ``prefix_depth``, where any pair over the threshold has
   that chance.
4. Nodes with the same members in several trees are kept once.  A node's members
   are dealt into blocks of bounded size and every two blocks meet in one task,
   which compares shingle sets exactly, counts each document's links and joins
   linked documents by a forest of edges; pairs are never written.  A pair that
   meets in several nodes counts in the first tree that it shares.
5. Connected components of the edges give the class ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import store
from chartloom.llm.words import mix, run_hashes, runs, slices

THRESHOLD, SHINGLE = 0.8, 5
TREES, DEPTH, RECALL = 12, 4, 0.9995
#: A block holds about this many documents, or this many shingles if that is fewer documents.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 300_000
_SEEDS = np.random.default_rng(20240501).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with the target recall at the threshold: where shortening ends at the latest."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice of texts and the text of each; shorter texts are one shingle, wordless ones none."""
    starts, ends, rows = runs(data, offsets)
    h = run_hashes(data, starts, ends)
    n_words = np.bincount(rows, minlength=len(offsets) - 1) if len(rows) else np.zeros(len(offsets) - 1, np.int64)
    with np.errstate(over="ignore"):
        wide = np.zeros(0, np.uint64)
        at = np.zeros(0, np.int64)
        if len(h) >= SHINGLE:
            wide = h[: len(h) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                wide = wide * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k]
            at = np.flatnonzero(rows[: len(wide)] == rows[SHINGLE - 1 :])
            wide = mix(wide[at])
            at = rows[at]
        few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
        if len(few):
            first = np.searchsorted(rows, few, "left")
            one = np.zeros(len(few), np.uint64)
            for k in range(SHINGLE - 1):
                more = k < n_words[few]
                one[more] = one[more] * np.uint64(0x9E3779B97F4A7C15) + h[first[more] + k]
            wide, at = np.r_[wide, mix(one + np.uint64(1))], np.r_[at, few]
            order = np.argsort(at, kind="stable")
            wide, at = wide[order], at[order]
    return wide, at


def _signer(batches) -> Iterator:
    """(id, text_key, signature, n_shingles); the signature is TREES * DEPTH u32, empty for wordless texts."""
    import pyarrow as pa

    for b in batches:
        signatures: list[bytes] = []
        sizes: list[int] = []
        for _, data, offsets in slices(b.column(2)):
            wide, at = shingle_sets(data, offsets)
            n = np.bincount(at, minlength=len(offsets) - 1)
            begin = np.flatnonzero(np.r_[True, np.diff(at) != 0]) if len(at) else at
            least = np.zeros((len(begin), len(_SEEDS)), np.uint32)
            with np.errstate(over="ignore"):
                for k, seed in enumerate(_SEEDS):
                    if len(begin):
                        x = wide * seed
                        least[:, k] = np.minimum.reduceat(((x ^ (x >> np.uint64(29))) * seed) >> np.uint64(32), begin)
            i = 0
            for size in n.tolist():
                signatures.append(least[i].tobytes() if size else b"")
                i += size > 0
            sizes += n.tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int32())], ["id", "text_key", "signature", "n_shingles"])


def _shingler(batches) -> Iterator:
    """(v, shingles): distinct sorted shingle hashes, 8 bytes each."""
    import pyarrow as pa

    for b in batches:
        out: list[bytes] = []
        for _, data, offsets in slices(b.column(1)):
            wide, at = shingle_sets(data, offsets)
            bounds = np.searchsorted(at, np.arange(len(offsets)))
            out += [np.unique(wide[s:e]).tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["v", "shingles"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by bitmaps over the shingles that two or more sets hold."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], number[code[keep]]
    width = int(shared.sum())
    out = np.zeros((m, m), np.int64)
    step = 1 << 14  # bitmaps of 16,384 shingles at a time bound the memory
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for low in range(0, width, step):
        a, e = np.searchsorted(code, [low, low + step])
        bits = np.zeros((m, min(step, width - low)), np.uint8)
        bits[owner[a:e], code[a:e] - low] = 1
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        for i in range(m):
            out[i, i:] += np.bitwise_count(packed[i] & packed[i:]).sum(axis=1, dtype=np.int64)
    return np.maximum(out, out.T)


def _prefix_codes(signature: np.ndarray, depth: int) -> np.ndarray:
    """Numbers [member, tree], equal where the prefixes are."""
    out = np.zeros(signature.shape[:2], np.int64)
    for tree in range(signature.shape[1]):
        _, out[:, tree] = np.unique(signature[:, tree, :depth], axis=0, return_inverse=True)
    return out


def chance(similarity, depth: int, trees: int = TREES):
    """The probability that a pair of this similarity shares a prefix in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _linker(threshold: float, depth: int, deepest: int):
    def link(table):
        """One task: members of one node's two blocks -> (v, links, to, pairs, missed); ``missed[k - 1]``: links unseen at depth k for those seen."""
        import pyarrow as pa

        ids = table.column("v").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        left = table.column("own").to_numpy()[order]
        first = table.column("tree")[0].as_py()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(ids), TREES, DEPTH)[order]
        new = ~np.eye(len(ids), dtype=bool)
        # Pairs inside one block belong to the task where the block meets itself.
        if table.column("pair_low")[0].as_py() != table.column("pair_high")[0].as_py():
            new &= left[:, None] != left
        if depth < deepest:  # compared in an earlier round
            for code in _prefix_codes(signature, depth + 1).T:
                new &= code[:, None] != code
        for code in _prefix_codes(signature[:, :first], depth).T:  # counted where they first meet
            new &= code[:, None] != code
        some = np.flatnonzero(new.any(axis=1))
        ids, new, order = ids[some], new[np.ix_(some, some)], order[some]
        copies = table.column("copies").to_numpy()[order]
        raw = table.column("shingles")
        sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in order]
        sizes = np.array([len(s) for s in sets], np.int64)
        both = intersections(sets)
        union = sizes[:, None] + sizes - both
        near = new & (both >= threshold * union - 1e-9)
        similarity = np.where(near, both / np.maximum(union, 1), 1.0)
        unseen = np.stack([(1 / chance(similarity, k) - 1).sum(axis=1) for k in range(1, DEPTH + 1)], axis=1)
        links = near @ copies
        label = np.arange(len(ids))
        while len(ids):  # least reachable member
            low = np.where(near, label[None, :], len(ids)).min(axis=1, initial=len(ids))
            now = np.minimum(label, low)
            now = now[now]
            if (now == label).all():
                break
            label = now
        keep = links > 0
        return pa.table({"v": ids[keep], "links": links[keep].astype(np.int64), "to": ids[label[keep]], "pairs": near.sum(axis=1)[keep].astype(np.int64), "missed": pa.array(list(unseen[keep]), pa.list_(pa.float64()))})

    return link


def _prefix(tree: int, depth: int):
    return F.xxhash64(F.lit(tree), F.substring("signature", 4 * DEPTH * tree + 1, 4 * depth))


def _candidates(reps: DataFrame, depth: int, deepest: int) -> DataFrame:
    """Members of trie nodes with pairs that part there: (node, tree, v, n_blocks), a node with equal members once."""
    parts = [F.struct(F.lit(t).alias("tree"), _prefix(t, depth).alias("node"), (_prefix(t, depth + 1) if depth < deepest else F.col("v")).alias("child")) for t in range(TREES)]
    below = reps.where(F.length("signature") > 0).select("v", "n_shingles", F.explode(F.array(*parts)).alias("p")).select("v", "n_shingles", "p.*")
    key = F.xxhash64("v", F.lit(7)).cast("decimal(20,0)")
    nodes = below.groupBy("node").agg(
        F.min("tree").alias("tree"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.sum(key).alias("sum1"), F.sum(F.xxhash64("v", F.lit(8)).cast("decimal(20,0)")).alias("sum2"),
        F.min("child").alias("low"), F.max("child").alias("high"),
    ).where("low != high")
    # Equal member sets have equal sizes and hash sums; the first tree stands for all.
    nodes = nodes.groupBy("n", "sum1", "sum2").agg(F.min_by(F.struct("node", "tree", "weight"), F.struct("tree", "node")).alias("x")).select("n", "x.*")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    return store.materialize(below.select("v", "node").join(nodes.select("node", "tree", blocks.alias("n_blocks")), "node"), "lsh-members")


def _compare(members: DataFrame, sets: DataFrame, threshold: float, depth: int, deepest: int) -> DataFrame:
    own = F.pmod(F.xxhash64("v", F.lit(3)), F.col("n_blocks")).cast("int")
    meets = members.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    meets = meets.withColumns({"pair_low": F.least("own", "other"), "pair_high": F.greatest("own", "other")})
    tasks = meets.join(sets, "v").groupBy("node", "pair_low", "pair_high").applyInArrow(_linker(threshold, depth, deepest), "v bigint, links bigint, to bigint, pairs bigint, missed array<double>")
    return store.materialize(tasks, "links")


def _enough(pairs: int, missed: float, recall: float) -> bool:
    """Whether the links found are the share ``recall`` of all, with three standard deviations to spare."""
    return pairs >= recall * (pairs + missed + 3 * missed**0.5 + 3)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of every connected component, from (a, b) edges.

    Alternates large-star and small-star steps; each ends in a stored table, and
    the steps stop when the edge table no longer changes.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
        view = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = view.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        least = store.materialize(least, "least")  # a plain table beside the edges: the join can split a hub's rows
        joined = view.join(least, F.col("a") == F.col("k"))
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = store.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = state(now)
    while True:
        now = store.materialize(star(star(now, True), False), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def forest_links(firsts: DataFrame, sets_of, threshold: float = THRESHOLD, recall: float = RECALL, deepest: int = DEPTH) -> DataFrame:
    """(v, links, to, pairs, missed) from all rounds; ``firsts`` has v, signature, n_shingles, copies.

    ``sets_of`` gives (v, shingles) of the wanted v; it is asked once, for the
    members of the shallowest nodes, which hold those of all deeper ones.
    """
    shallowest = min(deepest, prefix_depth(threshold, recall=recall))
    reps = firsts.select("v", "signature", "n_shingles")
    parts = [F.struct(_prefix(t, shallowest).alias("node")) for t in range(TREES)]
    below = reps.where(F.length("signature") > 0).select("v", F.explode(F.array(*parts)).alias("p")).select("v", "p.node")
    shared = below.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    wanted = store.materialize(below.join(shared, "node", "left_semi").select("v").distinct(), "lsh-candidates")
    sets = store.materialize(sets_of(wanted).join(firsts.select("v", "signature", "copies"), "v"), "lsh-sets")
    some = firsts.join(wanted, "v", "left_semi").select("v", "signature", "n_shingles")
    some = store.materialize(some, "lsh-signatures")

    found = None
    for depth in range(deepest, shallowest - 1, -1):
        linked = _compare(_candidates(some, depth, deepest), sets, threshold, depth, deepest)
        found = linked if found is None else found.unionByName(linked)
        pairs, missed = found.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum(F.get("missed", F.lit(depth - 1))), F.lit(0.0))).first()
        if _enough(pairs / 2, missed / 2, recall):
            break
    return found


def classify(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``join`` with the digest of the text as ``text_key``."""
    spark = docs.sparkSession
    store.small_batches(spark)
    text = store.text_of(text_column)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.unhex(F.md5(text)).alias("text_key"), text.rlike(r"[^ \t\n\r\f\x0b]").alias("worded"), text.alias("text"))
    keyed = store.materialize(rows.select("id", "text_key", "worded"), "text-keys")
    reps = keyed.where("worded").groupBy("text_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = store.materialize(reps, "text-classes")
    # A class is known by its first id; of several texts under one id, all but one (and null ids) by a hash of the text.
    owner = reps.groupBy("rep").agg(F.min("text_key").alias("owner")).withColumnRenamed("rep", "of")
    v = F.when(F.col("owner") == F.col("text_key"), F.col("rep")).otherwise(F.xxhash64("text_key").bitwiseOR(F.lit(-(2**63))))
    reps = store.materialize(reps.join(owner, F.col("rep") == F.col("of"), "left").select("text_key", "rep", "copies", v.alias("v")), "text-classes")

    signed = rows.where("worded").select("id", "text_key", "text").mapInArrow(_signer, "id bigint, text_key binary, signature binary, n_shingles int")
    signed = store.materialize(signed, "signatures")
    own = reps.select(F.col("text_key").alias("k"), "rep", "copies", "v")
    firsts = signed.join(own, F.col("id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("k"))).select("v", "signature", "n_shingles", "copies").dropDuplicates(["v"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        keys = own.join(wanted, "v", "left_semi").select(F.col("k"), "rep", "v")
        texts = rows.where("worded").select("id", "text_key", "text").join(keys.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("k")))
        return texts.select("v", "text").mapInArrow(_shingler, "v bigint, shingles binary").dropDuplicates(["v"])

    linked = forest_links(firsts, sets_of, threshold)
    roots = components(linked.select(F.col("v").alias("a"), F.col("to").alias("b")))
    links = linked.groupBy("v").agg(F.sum("links").alias("links"))
    roots = store.materialize(roots.select(F.col("id").alias("v"), "root").join(reps.select("v", "rep"), "v"), "roots")
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    classes = reps.join(links, "v", "left").join(roots.join(least, "root").select("v", "least"), "v", "left")
    classes = classes.select("text_key", "rep", F.coalesce("least", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = store.materialize(classes, "classes")
    joined = keyed.join(classes, "text_key", "left")
    return joined.select(F.col("id").alias("doc_id"), "text_key", F.coalesce("rep", "id").alias("copy_of"), F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def join(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``copy_of`` (least id with the same text), ``class_id``, ``n_links``.

    ``class_id`` is the least id of the connected component of links and
    ``n_links`` the number of other documents within the threshold, copies
    included.  Texts without a word (null, empty, blank) link to nothing, not
    even to one another.  Rows that repeat an id and text count as copies; an id
    with several texts stands for as many documents.  Rows with a null id are
    documents too, but no class is named after them where it has an id; an
    empty table gives an empty result.  Only the id and text columns are read.
    """
    return classify(docs, threshold, id_column, text_column).drop("text_key")


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document, that of least id, of every class; rows that repeat it go too.  Rows with a null id are kept."""
    named = docs.where(F.col(id_column).isNotNull())
    kept = classify(named, threshold, id_column, text_column).where("doc_id = class_id").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    rows = named.select(F.struct("*").alias("__row"), F.col(id_column).cast("bigint").alias("__own"), F.unhex(F.md5(store.text_of(text_column))).alias("__own_key"))
    one = rows.join(kept, (F.col("__own") == F.col("__id")) & (F.col("__own_key") == F.col("__key")), "left_semi").dropDuplicates(["__own", "__own_key"])
    return one.select("__row.*").unionByName(docs.where(F.col(id_column).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(store.documents(spark, sf_dir, "doc_id", "text"))


#: Every pair of texts that share a shingle, compared exactly; components by reachability.
ORACLE_SQL = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents
), class AS MATERIALIZED (
  SELECT text, min(doc_id) AS rep, count(*) AS copies, any_value(w) AS w FROM words WHERE len(w) > 0 GROUP BY text
), shingle AS MATERIALIZED (
  SELECT rep, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END) AS s
  FROM class
), size AS (
  SELECT rep, count(*) AS n FROM shingle GROUP BY rep
), meet AS (
  SELECT x.rep AS a, y.rep AS b, count(*) AS shared FROM shingle x JOIN shingle y ON x.s = y.s AND x.rep <> y.rep GROUP BY x.rep, y.rep
), edge AS MATERIALIZED (
  SELECT a, b FROM meet JOIN size p ON p.rep = a JOIN size q ON q.rep = b WHERE shared >= {THRESHOLD}::DOUBLE * (p.n + q.n - shared) - 1e-9
), reach AS (
  SELECT rep AS id, rep AS root FROM class
  UNION
  SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id AND edge.b > reach.root
), root AS (
  SELECT id, min(root) AS root FROM reach GROUP BY id
), link AS (
  SELECT a, sum(copies) AS links FROM edge JOIN class ON class.rep = b GROUP BY a
)
SELECT doc_id, coalesce(class.rep, doc_id) AS copy_of, coalesce(root.root, doc_id) AS class_id,
  CAST(coalesce(copies - 1, 0) + coalesce(links, 0) AS BIGINT) AS n_links
FROM words LEFT JOIN class ON class.text = words.text LEFT JOIN root ON root.id = class.rep LEFT JOIN link ON link.a = class.rep
"""
