"""Personal data: found by pattern, and by what the corpus shows to reveal it.

Base spans are e-mail and IP addresses, card and phone numbers.  Every value is
a protected entity.  A term (a run of letters or digits) near a mention may give
the entity away even when the value is masked.  With document counts n of N,

    disclosure(t, e) = PMI(t, e) / IC(e),
    PMI = log2(p(e | t) / p(e)),  IC = -log2 p(e),  p(e) = n(e) / N,
    p(e | t) = (n(t, e) + SMOOTHING p(e)) / (n(t) + SMOOTHING):

the share of what is to know about e that t tells, 1 when t occurs with e only
and often, 0 when independent.  The smoothed estimate lets entities count that
occur once, and discounts such evidence.  Candidates are the terms within
CONTEXT characters of a mention; all counts are of whole documents.  Terms
beyond GENERALISE are replaced by their category, terms beyond REMOVE removed,
wherever they occur in a document that holds the entity.  Everything is
DataFrame functions.

As p(e | t) is at most n(e) / n(t), a term too frequent for its entity is ruled
out before anything is joined, which keeps the joins about as large as the
documents with mentions.

Null texts count as empty and have no span.  Equal rows get equal results, null
ids are ids like others, an empty table gives an empty result.  Terms need word
boundaries: in scripts without spaces a term is a whole run of characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import store

GENERALISE, REMOVE = 0.8, 0.95
#: Weight of the prior in p(e | t), in documents.
SMOOTHING = 1.0
#: A pair of term and entity counts from so many documents with different texts.
MIN_TEXTS = 1
CONTEXT = 64
#: Bits of the sketch of the texts with spans; as many rows at most as SKETCH_BITS / 64 are broadcast.
SKETCH_BITS = 1 << 22
_NAME = "A-Za-z0-9._%+-"
#: The base patterns with the same valid matches in time linear in the text: a match starts
#: where a run of its first class starts (or the last match ended), and runs are possessive.
#: Card runs of other lengths than 13 to 19 digits are passed over as a whole.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TERM = "array<struct<start:int,end:int,value:string,action:string>>"
_WORD = r"[\p{L}\p{N}]++"
#: Text is handled in blocks of this many characters where pieces of it are taken by position.
_BLOCK = 256


def _let(value, body):
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values, step):
    """``step`` folded over each prefix of an array (``step`` associative), by doubling: n log n and no copy per element."""

    def double(acc, k):
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, step(F.get(acc, i - back), x)).otherwise(x))

    rounds = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, values, double)


def matches(text, pattern: str):
    """Leftmost non-overlapping matches with code-point positions: array of (start, end, value)."""

    def place(s):
        lengths = F.transform(s["m"], lambda v, i: F.length(F.get(s["p"], i)) + F.length(v))
        return _let(running(lengths, lambda a, b: a + b), lambda ends: F.transform(s["m"], lambda v, i: F.struct((F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"))))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), place)


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    """Whether the digits pass the check: from the right, every second digit doubled, digits summed."""

    def term(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), term), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value):
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda d: F.when(F.length(d) > 3, False).otherwise(F.coalesce(F.try_to_number(d, F.lit("999")).cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text):
    """All base spans, by kind as listed, then start."""
    return F.concat(*[_spans_of(text, kind) for kind in PATTERNS])


def _spans_of(text, kind: str):
    hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")
    spans = F.filter(matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    spans = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["value"]))
    return F.when(hint, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _entity(span):
    key = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.xxhash64(span["kind"], key)


def pieces_at(text, ranges):
    """The text between the positions (from, to) of each range; linear in the text and the ranges."""

    def cut(blocks):
        def piece(r):
            a, b = F.floor(r["from"] / _BLOCK).cast("int"), F.floor(r["to"] / _BLOCK).cast("int")
            first, last = F.coalesce(F.get(blocks, a), F.lit("")), F.coalesce(F.get(blocks, b), F.lit(""))
            begin = F.pmod(r["from"], F.lit(_BLOCK)).cast("int") + 1
            across = F.concat(F.substring(first, begin, F.lit(_BLOCK)), F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(last, F.lit(1), F.pmod(r["to"], F.lit(_BLOCK)).cast("int")))
            return F.when(r["to"] <= r["from"], "").when(a == b, F.substring(first, begin, (r["to"] - r["from"]).cast("int"))).otherwise(across)

        return F.transform(ranges, piece)

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), cut)


def contexts(text, base):
    """The terms near each base span that no base span covers, with the span's entity: array of (entity, term), a pair as often as it occurs."""
    n = F.length(text)
    around = F.transform(base, lambda s: F.struct(F.greatest(s["start"] - CONTEXT - 1, F.lit(0)).alias("from"), F.least(s["end"] + CONTEXT + 1, n).alias("to")))

    def near(s, i, windows):
        window, low = F.get(windows, i), F.greatest(s["start"] - CONTEXT - 1, F.lit(0))
        # A word cut by the window's edge is not whole.
        words = F.filter(matches(window, _WORD), lambda w: ((w["start"] > 0) | (low == 0)) & ((w["end"] < F.length(window)) | (s["end"] + CONTEXT + 1 >= n)))
        words = F.filter(words, lambda w: (low + w["end"] <= s["start"]) | (low + w["start"] >= s["end"]))
        return F.transform(F.array_distinct(F.transform(words, lambda w: F.lower(w["value"]))), lambda t: F.struct(_entity(s).alias("entity"), t.alias("term")))

    return _let(pieces_at(text, around), lambda windows: F.flatten(F.transform(base, lambda s, i: near(s, i, windows))))


def _key(id_column: str):
    """The id as text; null is an id of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit(""))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, its ``key``, a hash of the text, ``base`` and, where that is not empty, the text; written once to the shared folder."""
    text = store.text_of(text_column)
    found = docs.select(F.col(id_column).alias("id"), _key(id_column).alias("key"), F.xxhash64(text).alias("text_hash"), base_spans(text).alias("base"), text.alias("text"))
    return store.materialize(found.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "pii")


def _mentioning(found: DataFrame) -> DataFrame:
    """The distinct (key, text_hash) with base spans, their text and number of rows; written once."""
    some = found.where(F.size("base") > 0).groupBy("key", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.first("base").alias("base"), F.first("text").alias("text"))
    return store.materialize(some, "pii-documents")


def scores(docs: DataFrame, found: DataFrame, mentioning: DataFrame, text_column: str = "text", min_texts: int = MIN_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(entity, term, n_both, n_term, n_entity, disclosure) of candidates, and (key, text_hash, entity, term) of the documents that hold both."""
    total = float(max(found.count(), 1))
    # Pairs are told apart here and not in the array, where Spark would compare all of them with each other.
    near = mentioning.select(F.explode(contexts(F.col("text"), F.col("base"))).alias("c")).select("c.*")
    pairs = store.materialize(near.distinct(), "pii-pairs")
    holders = mentioning.select("key", "text_hash", "rows", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    entities = holders.groupBy("entity").agg(F.sum("rows").alias("n_entity"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(store.text_of(text_column)), F.lit(_WORD), F.lit(0)))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))

    ic = -F.log2(F.col("n_entity") / total)

    def disclosure(n_both):
        prior = F.col("n_entity") / total
        given = (n_both + SMOOTHING * prior) / (F.col("n_term") + SMOOTHING)
        return F.when(ic > 0, F.log2(given / prior) / ic).otherwise(0.0)

    # With n(t, e) at its most, min(n(t), n(e)), most pairs are ruled out.
    bound = disclosure(F.least("n_term", "n_entity"))
    candidates = pairs.join(terms, "term").join(entities, "entity").where(bound >= GENERALISE).select("entity", "term", "n_term", "n_entity")
    candidates = store.materialize(candidates, "pii-candidates")

    wanted = store.materialize(candidates.select("term").distinct(), "pii-terms")
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))
    held = store.materialize(mentioning.select("key", "text_hash", F.explode(own).alias("term")).join(wanted, "term", "left_semi"), "pii-held")
    both = held.join(candidates.select("entity", "term"), "term").join(holders, ["key", "text_hash", "entity"]).select("key", "text_hash", "entity", "term", "rows")
    both = store.materialize(both, "pii-both")
    counted = both.groupBy("entity", "term", "text_hash").agg(F.sum("rows").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("texts"))
    scored = counted.where(F.col("texts") >= min_texts).join(candidates, ["entity", "term"]).withColumn("disclosure", disclosure(F.col("n_both")))
    return scored.drop("texts"), both


def disclosing(docs: DataFrame, found: DataFrame, text_column: str = "text", min_texts: int = MIN_TEXTS) -> DataFrame:
    """Term spans by (key, text_hash): ``terms`` is an array of (start, end, value, action), by start; outside base spans."""
    mentioning = _mentioning(found)
    scored, both = scores(docs, found, mentioning, text_column, min_texts)
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    flagged = store.materialize(scored.where(F.col("disclosure") >= GENERALISE).select("entity", "term", action.alias("action")), "pii-flagged")
    wanted = both.join(flagged, ["entity", "term"]).groupBy("key", "text_hash", "term").agg(F.max("action").alias("action"))
    wanted = store.materialize(wanted, "pii-hits")

    # Whole documents: every word, joined to the document's flagged terms.
    hit = store.materialize(wanted.select("key", "text_hash").distinct(), "pii-hit-documents")
    placed = mentioning.join(hit, ["key", "text_hash"], "left_semi").select("key", "text_hash", "base", F.explode(matches(F.col("text"), _WORD)).alias("w"))
    placed = placed.select("key", "text_hash", F.lower("w.value").alias("term"), "w.*").join(wanted, ["key", "text_hash", "term"])
    terms = placed.groupBy("key", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value", "action"))).alias("terms"))  # words of one document
    whole = terms.join(mentioning.select("key", "text_hash", "base"), ["key", "text_hash"])
    return whole.select("key", "text_hash", _outside("terms", "base").alias("terms"))


def _outside(terms: str, base: str):
    """Terms that no base span overlaps: both sorted by start together, a term is out where an earlier span reaches beyond its start or its end the next span's start."""
    spans = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("o"), s["end"].alias("end"), F.lit("").alias("value"), F.lit("").alias("action")))
    words = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("o"), t["end"].alias("end"), t["value"].alias("value"), t["action"].alias("action")))

    def keep(every):
        reach = running(F.transform(every, lambda e: F.when(e["o"] == 0, e["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        ahead = F.reverse(running(F.reverse(F.transform(every, lambda e: F.when(e["o"] == 0, e["start"]).otherwise(2**31 - 1))), lambda a, b: F.least(a, b)))
        free = F.zip_with(F.zip_with(every, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), ahead, lambda x, s: F.struct(x["e"].alias("e"), (x["e"]["o"] == 1) & (x["r"] <= x["e"]["start"]) & (s >= x["e"]["end"])))
        return F.transform(F.filter(free, lambda x: x["col2"]), lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["value"].alias("value"), x["e"]["action"].alias("action")))

    return _let(F.array_sort(F.concat(spans, words)), keep)


def category(value):
    """What a generalised term is replaced by: a number, a name (capitalised) or a word."""
    return F.when(value.rlike(r"^\p{N}+$"), "[NUMBER]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def sanitised(text, base, terms):
    """The text with base spans masked and disclosing terms generalised or removed; of overlapping spans the first decides."""
    mask = F.create_map(*[F.lit(x) for p in MASKS.items() for x in p])
    spans = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(mask, s["kind"]).alias("mask"))),
        F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "remove", "").otherwise(category(t["value"])).alias("mask"))),
    )

    def rewrite(s):
        def between(reach):
            before = lambda i: F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
            gaps = F.transform(s, lambda x, i: F.struct(before(i).alias("from"), x["start"].alias("to")))
            gaps = F.concat(gaps, F.array(F.struct(F.element_at(reach, -1).alias("from"), F.length(text).alias("to"))))
            masks = F.concat(F.transform(s, lambda x, i: F.when(x["start"] >= before(i), x["mask"]).otherwise("")), F.array(F.lit("")))
            return F.array_join(F.zip_with(pieces_at(text, gaps), masks, lambda a, b: F.concat(a, b)), "")

        return _let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), between)

    return F.when(F.size(base) + F.size(terms) == 0, text).otherwise(_let(F.array_sort(spans), rewrite))


def _sketched(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with ``__may``: true for every row whose text hash is among those of ``spans``, and for few others while these are few.

    The sketch has SKETCH_BITS bits, in words of 64, whatever the number of spans.
    """

    def word_and_bit(text_hash):
        place = F.pmod(F.xxhash64(text_hash), F.lit(SKETCH_BITS)).cast("bigint")
        return F.floor(place / 64), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))

    word, bit = word_and_bit(F.col("__hash"))
    words = store.materialize(spans.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits")), "pii-sketch")  # at most SKETCH_BITS / 64 rows
    word, bit = word_and_bit(F.col("__text_hash"))
    sketched = rows.join(F.broadcast(words), word == F.col("__word"), "left")
    return sketched.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).select(*rows.columns, "__may")


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with sanitised text; rows without a span are unchanged (null stays null)."""
    found = find(docs, id_column, text_column)
    spans = found.where(F.size("base") > 0).dropDuplicates(["key", "text_hash"]).join(disclosing(docs, found, text_column), ["key", "text_hash"], "left")
    spans = spans.select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("__base"), F.coalesce("terms", F.array().cast(TERM)).alias("__terms"))
    spans = store.materialize(spans, "pii-spans")
    rows = docs.select(F.struct("*").alias("__row"), _key(id_column).alias("__own"), F.xxhash64(store.text_of(text_column)).alias("__text_hash"))
    # Only the texts that may have a span are shuffled to their spans.
    rows = _sketched(rows, spans)
    found = rows.where("__may").join(spans, (F.col("__own") == F.col("__key")) & (F.col("__text_hash") == F.col("__hash")), "left")
    none = rows.where("not __may").withColumns({"__base": F.lit(None).cast(spans.schema["__base"].dataType), "__terms": F.lit(None).cast(TERM)})
    joined = found.select("__row", "__base", "__terms").unionByName(none.select("__row", "__base", "__terms"))
    own = F.col("__row")[text_column]
    text = F.when(F.col("__base").isNull(), own).otherwise(sanitised(own, F.col("__base"), F.col("__terms")))
    return joined.select(*[text.alias(c) if c == text_column else F.col("__row")[c].alias(c) for c in docs.columns])


def _count_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir, "doc_id", "text")
    found = find(docs)
    spans = found.join(store.materialize(disclosing(docs, found), "pii-disclosing"), ["key", "text_hash"], "left")
    listed = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    extra = F.transform(F.coalesce("terms", F.array().cast(TERM)), lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    counts = [_count_of(k).alias(f"n_{k}") for k in PATTERNS]
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.array_join(listed, ","), 256).alias("base_sha256"), F.array_join(F.concat(listed, extra), ",").alias("spans"))
