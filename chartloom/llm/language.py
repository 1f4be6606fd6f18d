"""Language identification by segmentation-marginalised unigram models.

Every language has its own probabilities over one fixed public vocabulary of
pieces.  The likelihood of a word is the sum over all its segmentations into
pieces, by the forward algorithm; that of a text is the product over its words
(no piece crosses white space, so this is the sum over all segmentations of the
text).  Probabilities are fitted by expectation maximisation on word counts,
each round a Spark job over the words of the sample.

Texts are lower-cased; words are runs of letters and non-ASCII bytes, of any
length: a sentence of a script without spaces is one word.  The vocabulary's
single bytes from 128 on are pieces too, so that every script is learned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from chartloom.llm import store
from chartloom.llm.tokens import vocabulary_path
from chartloom.llm.words import HashIndex, run_hashes, runs, slices, spread

#: The fit reads about this many labelled documents of every language (all, where there are fewer).
SAMPLE_DOCS = 5_000
EM_ROUNDS = 3
#: Longer words are learned from in segments of at most this many bytes, cut between characters.
SEGMENT = 32
#: Words up to this many bytes are scored by plain recursion, longer ones in blocks of BLOCK bytes.
PLAIN, BLOCK = 512, 16
FLOOR = 1e-7
UNDETERMINED = "und"

_GAP = np.zeros(256, bool)
_GAP[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = True
_RESCALE = 8


def pieces(path: str | None = None) -> list[bytes]:
    """The vocabulary: the letter pieces of a sentencepiece file and its bytes from 128 on; a leading 0x20 marks a word start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path("piece_bpe_32k.model"))
    found = {b" "}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[1:-1], 16)
            found |= {bytes([value])} if value >= 128 else set()
        elif not (model.is_control(i) or model.is_unknown(i)):
            p = model.id_to_piece(i).lower().replace("▁", " ")
            if p.removeprefix(" ").isalpha():
                found.add(p.encode())
    return sorted(found)


class Lattice:
    """Finds all pieces in words by walking the trie of the vocabulary from every position at once."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.longest = max(map(len, vocabulary))
        prefixes = {p[:k]: -1 for p in vocabulary for k in range(1, len(p) + 1)}
        prefixes |= {p: i for i, p in enumerate(vocabulary)}
        self.index = HashIndex(max(12, (5 * len(prefixes)).bit_length()))
        data = np.frombuffer(b"".join(prefixes), np.uint8)
        ends = np.cumsum([len(p) for p in prefixes])
        self.index.add(run_hashes(data, np.r_[0, ends[:-1]], ends))
        self.piece = np.array(list(prefixes.values()), np.int32)

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, piece) of all pieces in ``data``, whose words end at ``ends``."""
        limit = np.repeat(ends, np.diff(np.r_[0, ends]))
        alive = np.arange(len(data))
        out = []
        for n in range(1, self.longest + 1):
            alive = alive[alive + n <= limit[alive]]
            if not len(alive):
                break
            at = self.index.find(run_hashes(data, alive, alive + n))
            alive, at = alive[at >= 0], at[at >= 0]
            piece = self.piece[at]
            whole = piece >= 0
            out.append((alive[whole], np.full(int(whole.sum()), n, np.int64), piece[whole]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words with their start marks in one buffer, and where each ends."""
    padded = [b" " + w for w in words]
    return np.frombuffer(b"".join(padded), np.uint8), np.cumsum([len(p) for p in padded])


class Steps:
    """The edges of a batch of words by end position, for recursions that take one position of all words at a time."""

    def __init__(self, lattice: Lattice, words: list[bytes]) -> None:
        data, ends = _joined(words)
        begin, length, piece = lattice.edges(data, ends)
        firsts = np.r_[0, ends[:-1]]
        self.lengths = ends - firsts
        self.width = int(self.lengths.max()) + 1
        word = np.searchsorted(ends, begin, "right")
        start = begin - firsts[word]
        order = np.lexsort((word, start + length))
        self.word, self.start, self.piece = word[order], start[order], piece[order]
        self.bounds = np.searchsorted((start + length)[order], np.arange(self.width + 1))

    def at(self, t: int):
        """Words, start positions and pieces of the edges that end at ``t``, and where each word's edges begin."""
        s = slice(self.bounds[t], self.bounds[t + 1])
        word = self.word[s]
        return word, self.start[s], self.piece[s], np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word


def forward(steps: Steps, p: np.ndarray, longest: int, lang: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """alpha[word, position, language] and log scales[word, position, language]: the sums are alpha * exp(scale).

    A byte that no piece covers alone has FLOOR.  With ``lang``, only each word's own language is computed.
    """
    n, k = len(steps.lengths), p.shape[1] if lang is None else 1
    alpha, scale = np.zeros((n, steps.width, k)), np.zeros((n, steps.width, k))
    alpha[:, 0] = 1
    for t in range(1, steps.width):
        alpha[:, t] = alpha[:, t - 1] * FLOOR
        word, start, piece, first = steps.at(t)
        if len(word):
            flow = alpha[word, start] * (p[piece] if lang is None else p[piece, lang[word]][:, None])
            alpha[word[first], t] += np.add.reduceat(flow, first)
        scale[:, t] = scale[:, t - 1]
        if t % _RESCALE == 0:
            # Positions that later edges start from are brought to one scale, in which the last is 1.
            top = np.where((steps.lengths >= t)[:, None], np.maximum(alpha[:, t], 1e-300), 1.0)
            window = slice(max(0, t - longest), t + 1)
            alpha[:, window] /= top[:, None]
            scale[:, window] += np.log(top)[:, None]
    return alpha, scale


def _ends_log(alpha: np.ndarray, scale: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    rows = np.arange(len(lengths))
    return np.log(np.maximum(alpha[rows, lengths], 1e-300)) + scale[rows, lengths]


def expected(lattice: Lattice, words: list[bytes], lang: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language] in words of at most SEGMENT bytes, each ``counts`` times in its language."""
    out = np.zeros(p.shape)
    order = np.argsort([len(w) for w in words], kind="stable")
    for i in range(0, len(words), 4000):
        part = order[i : i + 4000]
        steps, own = Steps(lattice, [words[k] for k in part]), lang[part]
        alpha, scale = (x[:, :, 0] for x in forward(steps, p, lattice.longest, own))
        rows = np.arange(len(part))
        beta = np.zeros_like(alpha)
        beta[rows, steps.lengths] = 1
        # A position's scale relative to the whole word's likelihood, times the word's count.
        base = scale - _ends_log(alpha, scale, steps.lengths)[:, None]
        weight = alpha * np.exp(np.minimum(base, 600)) * counts[part][:, None]
        for t in range(steps.width - 1, 0, -1):
            word, start, piece, _ = steps.at(t)
            if len(word):
                flow = p[piece, own[word]] * beta[word, t]
                np.add.at(beta, (word, start), flow)
                np.add.at(out, (piece, own[word]), flow * weight[word, start])
            beta[:, t - 1] += beta[:, t] * FLOOR
    return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: list[bytes]
    p: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """Word log-likelihoods with a bounded per-worker cache."""

    def __init__(self, model: Model, bits: int = 20) -> None:
        self.model, self.lattice = model, Lattice(model.vocabulary)
        self.index = HashIndex(bits)
        self.log = np.zeros((self.index.capacity, len(model.languages)), np.float32)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihoods [word, language] of words of any length."""
        out = np.zeros((len(words), len(self.model.languages)))
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= PLAIN]
        i = 0
        while i < len(short):  # words of like length together: little padding, and bounded tables
            step = max(1, min(2000, 100_000 // (int(lengths[short[min(i + 1999, len(short) - 1)]]) + 1)))
            part = short[i : i + step]
            steps = Steps(self.lattice, [words[k] for k in part])
            out[part] = _ends_log(*forward(steps, self.model.p, self.lattice.longest), steps.lengths)
            i += step
        for k in order[len(short) :]:
            out[k] = self.long_word(words[k])
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        """The forward recursion of one word, block by block.

        What a block does to the last ``longest`` sums is a matrix; the matrices
        of many blocks are made together, and then applied in order.
        """
        p, w, k = self.model.p, self.lattice.longest, len(self.model.languages)
        data, ends = _joined([word])
        state = np.zeros((w, k))  # state[i]: the sum up to the position i before the present one
        state[0] = 1
        log = np.zeros(k)
        part = 4096 * BLOCK  # edges of a stretch of the word at a time
        eye = np.broadcast_to(np.eye(w)[:, :, None], (w, w, k))
        for low in range(0, len(data), part):
            high = min(low + part, len(data))
            left = max(0, low - w)
            begin, length, piece = self.lattice.edges(data[left:high], np.array([high - left]))
            end = begin + left + length
            new = end > low
            end, length, piece = end[new] - low - 1, length[new], piece[new]
            order = np.argsort(end % BLOCK, kind="stable")
            block, at, length, piece = end[order] // BLOCK, end[order] % BLOCK, length[order], piece[order]
            bounds = np.searchsorted(at, np.arange(BLOCK + 1))
            n_blocks = -(-(high - low) // BLOCK)
            for first in range(0, n_blocks, 128):
                n = min(128, n_blocks - first)
                sums = np.zeros((n, w + BLOCK, w, k))
                sums[:, :w] = eye[::-1]
                for t in range(BLOCK):
                    sums[:, w + t] = sums[:, w + t - 1] * FLOOR
                    s = slice(bounds[t], bounds[t + 1])
                    mine = (block[s] >= first) & (block[s] < first + n)
                    np.add.at(sums, (block[s][mine] - first, w + t), sums[block[s][mine] - first, w + t - length[s][mine]] * p[piece[s][mine]][:, None, :])
                for b in range(n):
                    size = min(BLOCK, high - low - (first + b) * BLOCK)
                    state = np.einsum("ijk,jk->ik", sums[b, size : size + w][::-1], state)
                    top = np.maximum(state.max(axis=0), 1e-300)
                    state /= top
                    log += np.log(top)
        return log + np.log(np.maximum(state[0], 1e-300))

    def score(self, texts) -> np.ndarray:
        """Log-likelihoods [text, language] of an Arrow array of lower-cased texts."""
        out = np.zeros((len(texts), len(self.model.languages)))
        for row, data, offsets in slices(texts):
            starts, ends, rows = runs(data, offsets, _GAP)
            h = run_hashes(data, starts, ends)
            at = self.index.find(h)
            log = self.log[at]
            new = np.flatnonzero(at < 0)
            if len(new):
                fresh, first, back = np.unique(h[new], return_index=True, return_inverse=True)
                raw = data.tobytes()
                value = self.words([raw[s:e] for s, e in zip(starts[new[first]].tolist(), ends[new[first]].tolist())])
                log[new] = value[back]
                if self.index.n + len(fresh) > self.index.capacity:
                    self.index.clear()
                fresh, value = fresh[: self.index.capacity], value[: self.index.capacity]
                self.log[self.index.add(fresh)] = value
            n = len(offsets) - 1
            for k in range(out.shape[1]):
                out[row : row + n, k] = np.bincount(rows, weights=log[:, k], minlength=n)
        return out


def _lower(column):
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def _segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut into segments of at most SEGMENT bytes between characters: starts, ends and the run of each."""
    n = -(-(ends - starts) // (SEGMENT - 3))
    run = np.repeat(np.arange(len(starts)), n)
    nth = spread(np.zeros(len(n), np.int64), n)
    cut = starts[run] + nth * (SEGMENT - 3)
    for _ in range(3):  # on to the next character's first byte
        inside = (nth > 0) & (cut < ends[run]) & (data[np.minimum(cut, len(data) - 1)] & 0xC0 == 0x80)
        cut = cut + inside
    stop = np.where(np.r_[run[1:] == run[:-1], False] if len(run) else np.zeros(0, bool), np.r_[cut[1:], 0][: len(cut)], ends[run])
    good = stop > cut
    return cut[good], stop[good], run[good]


def _count_words(batches) -> Iterator:
    """(lang, word, n) of a batch; long words in segments."""
    import pyarrow as pa

    for b in batches:
        langs = np.array(b.column(0).to_pylist(), object)
        out: dict[tuple, int] = {}
        for row, data, offsets in slices(_lower(b.column(1))):
            starts, ends, rows = runs(data, offsets, _GAP)
            if not len(starts):
                continue
            starts, ends, run = _segments(data, starts, ends)
            rows = rows[run]
            names, code = np.unique(langs[row : row + len(offsets) - 1].astype(str), return_inverse=True)
            h = run_hashes(data, starts, ends) + code[rows].astype(np.uint64)
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            for i, k in zip(first.tolist(), n.tolist()):
                key = (str(names[code[rows[i]]]), raw[starts[i] : ends[i]])
                out[key] = out.get(key, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.binary()), pa.array(list(out.values()), pa.int64())], ["lang", "word", "n"])


_lattices: dict[str, Lattice] = {}


def _expectation(shared):
    """(piece, expected count by language) of a task's words."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        model: Model = shared.value
        if model.key not in _lattices:
            _lattices.clear()
            _lattices[model.key] = Lattice(model.vocabulary)
        at = {x: i for i, x in enumerate(model.languages)}
        total = np.zeros(model.p.shape)
        words, lang, counts = [], [], []
        for b in chain(batches, [None]):
            if b is not None:
                lang += [at[x] for x in b.column(0).to_pylist()]
                words += b.column(1).to_pylist()
                counts += b.column(2).to_pylist()
            if words and (b is None or len(words) >= 16_000):  # words are short: whole arrays, not batches
                total += expected(_lattices[model.key], words, np.array(lang), np.array(counts, float), model.p)
                words, lang, counts = [], [], []
        some = np.flatnonzero(total.sum(axis=1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["piece", "n"])

    return run


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: str | None = None, rounds: int = EM_ROUNDS) -> Model:
    """Fit on (doc_id, text, lang) rows; those with null text or lang are ignored.

    Every language is sampled by itself, so that rare ones keep all their rows.
    The words of the sample stay on the executors; the driver gets one number a
    piece and language in a round.
    """
    spark = labelled.sparkSession
    store.small_batches(spark)
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    large = {x: n for x, n in sizes.items() if n > sample_docs}
    if large:
        share = F.create_map(*[F.lit(v) for x, n in large.items() for v in (x, int(2**63 * (2 * sample_docs / n - 1)))])
        rows = rows.where(F.xxhash64("doc_id", "text", F.lit("language sample")) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(2**63 - 1)))
    counted = rows.select("lang", "text").mapInArrow(_count_words, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = store.materialize(counted, "language-words")
    vocab, languages = pieces(vocabulary), sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    model = Model(languages, vocab, np.full((len(vocab), max(1, len(languages))), 1 / len(vocab)))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(model)  # vocabulary x languages numbers
        parts = counted.mapInArrow(_expectation(shared), "piece bigint, n array<double>")
        sums = parts.groupBy("piece").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(len(languages))])
        n = np.full(model.p.shape, 1e-3)
        for r in sums.collect():  # at most one row a piece
            n[r[0]] += r[1:]
        model = Model(languages, vocab, n / n.sum(axis=0), model.key)
        shared.unpersist()
    return model


_scorers: dict[str, Scorer] = {}


def _predictor(shared, key: str):
    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scorer = _scorers[key]
        languages = scorer.model.languages
        for b in batches:
            texts = b.column(1)
            texts = texts.fill_null("") if texts.null_count else texts
            log = scorer.score(_lower(texts)) if languages else np.zeros((len(texts), 1))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            best = log.argmax(axis=1)
            posterior = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
            known = letters if languages else np.zeros(len(texts), bool)
            lang = [languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, posterior, 0.0))], ["__row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), ``lang_pred`` and ``score``, the posterior under equal priors.

    Null texts and texts without a letter get "und" and 0; so does every text
    when nothing was learned.  Ties go to the first language by name.  Equal
    rows get equal results, an empty table an empty one; columns named as the
    two results are replaced by them.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c in store.others(docs, "lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)  # vocabulary x languages numbers
    row = F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("__none")]).alias("__row")
    packed = docs.select(row, F.col(text_column).alias("__text"))
    schema = StructType([packed.schema["__row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return packed.mapInArrow(_predictor(shared, uuid.uuid4().hex), schema).select(*[F.col("__row")[c].alias(c) for c in keep], "lang_pred", "score")


def held_out(column: str = "doc_id"):
    """Whether crc32(id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def model_of(docs: DataFrame) -> Model:
    """The model that the query and the pipeline use: learned from documents that are not held out."""
    return train(docs.where(~held_out()).select("doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir, "doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), model_of(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
