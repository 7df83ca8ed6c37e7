"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed: the lower-cased pieces of a public tokenizer that hold letters only, with or without the word marker. For
each language, piece probabilities are learned by expectation-maximisation over all segmentations of sampled words. A word's
probability is the forward sum over all its segmentations; a text's is the product over its words, since no piece crosses words.

Text is lower-cased; words are maximal runs of letters, of any length: text without spaces is one word, summed over all its
segmentations in memory that doesn't grow with it. A letter that no piece covers costs ``UNKNOWN`` in every language.

The model is fitted on a bounded sample: at most about ``SAMPLE`` labelled documents of a language, picked by a hash of doc_id, and of
their words of at most ``LONGEST`` letters the ``WORDS`` most frequent, so neither the driver's part nor the model's size grows with the
table or its texts. Every document is scored on its whole text. Null text, or text without a letter: ``und``
with score 0. Without any labelled document all are ``und``. A null doc_id is scored like any other and never learned from. Ties go to the
language that sorts first. Repeated rows give repeated results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
SAMPLE, WORDS, ROUNDS, SMOOTH, LONGEST, UNKNOWN = 500, 50_000, 4, 0.05, 48, 1e-7
#: Each letter's scale in the forward sums, so that they neither vanish nor overflow.
SCALE = np.exp(2.3)
MARK = ord("▁")
KEEP = 200_000
#: Bytes of text judged at once.
SLICE = 1 << 20
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"

_B = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 22


@dataclass
class Pieces:
    """Distinct letter pieces, found by a 64-bit hash: a first table by the upper bits, a second for those that met in it."""

    hashes: np.ndarray
    slot: np.ndarray
    again: np.ndarray
    longest: int

    @staticmethod
    def load(model: str = MODEL) -> Pieces:
        from .chunks import piece_processor

        sp = piece_processor(model)
        words = {sp.id_to_piece(i).lower() for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        keep = sorted(w for w in words if w == "▁" or w.removeprefix("▁").isalpha())
        hashes = np.array([hash_of(w) for w in keep], np.uint64)
        assert len(np.unique(hashes)) == len(hashes)
        slot, again = np.full(1 << _SLOT_BITS, -1, np.int32), np.full(1 << 16, -1, np.int32)
        for i, h in enumerate(hashes.tolist()):
            s = h >> 64 - _SLOT_BITS
            if slot[s] < 0:
                slot[s] = i
            else:
                s = h >> 20 & 0xFFFF
                assert again[s] < 0
                again[s] = i
        return Pieces(hashes, slot, again, max(map(len, keep)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, or -1."""
        i = self.slot[(h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        wrong = (i < 0) | (self.hashes[i] != h)
        j = self.again[(h[wrong] >> np.uint64(20) & np.uint64(0xFFFF)).astype(np.int64)]
        i[wrong] = np.where((j >= 0) & (self.hashes[j] == h[wrong]), j, -1)
        return i


def hash_of(w: str) -> int:
    h = 0
    for c in w:
        h = ((h + ord(c) + 1) * int(_B)) & (2**64 - 1)
        h ^= h >> 29
    return h


_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def words_of(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words (UTF-32 bytes, dictionary-encoded) of the texts in order, and the first word of each text, one more at the end."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in low])
    is_letter = letter_table()[points]
    first = is_letter.copy()
    first[1:] &= ~is_letter[:-1]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    inside = starts[starts < len(points)]
    first[inside] = is_letter[inside]
    letters = points[is_letter]
    at = np.flatnonzero(first[is_letter])
    bounds = np.append(at, len(letters)) if len(at) else np.zeros(1, np.int64)
    arr = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])
    before = np.concatenate(([0], np.cumsum(is_letter)))  # letters before each place
    return arr.dictionary_encode(), np.searchsorted(at, before[np.concatenate((starts, ends[-1:])).astype(np.int64)])


def _matches(pieces: Pieces, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, length, rows, pieces) of all pieces in words of one length (rows x letters, marker first)."""
    n = chars.shape[1]
    for s in range(n):
        h = np.zeros(len(chars), np.uint64)
        for size in range(1, min(pieces.longest, n - s) + 1):
            h = (h + chars[:, s + size - 1] + np.uint64(1)) * _B
            h ^= h >> np.uint64(29)
            found = pieces.find(h)
            rows = np.flatnonzero(found >= 0)
            if len(rows):
                yield s, size, rows, found[rows]


def _forward(pieces: Pieces, chars: np.ndarray, p: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Log-probability in each language (columns of p) of words of one length. With counts (word x language), adds expected piece counts."""
    m, n = chars.shape
    k = p.shape[1]
    alpha = np.zeros((n + 1, m, k))
    alpha[0] = 1.0
    scale = SCALE ** np.arange(pieces.longest + 1)
    seen = list(_matches(pieces, chars))
    by_start: dict[int, list] = {}
    for x in seen:
        by_start.setdefault(x[0], []).append(x)
    for s in range(n):
        alpha[s + 1] += alpha[s] * (UNKNOWN * SCALE)
        for _, size, rows, found in by_start.get(s, ()):
            alpha[s + size][rows] += alpha[s][rows] * (p[found] * scale[size])
    if expected is not None:
        beta = np.zeros((n + 1, m, k))
        beta[n] = 1.0
        weight = counts / alpha[n]
        for s in range(n - 1, -1, -1):
            beta[s] += beta[s + 1] * (UNKNOWN * SCALE)
            for _, size, rows, found in by_start.get(s, ()):
                step = p[found] * scale[size] * beta[s + size][rows]
                beta[s][rows] += step
                np.add.at(expected, found, step * alpha[s][rows] * weight[rows])
    return np.log(alpha[n]) - n * np.log(SCALE)


#: Letters of a long word that are matched at once.
STRETCH = 1 << 16


def _forward_long(pieces: Pieces, chars: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-probability in each language of one word of any length: the sums that end at the last few letters are kept, and scaled as they shrink."""
    k, most = p.shape[1], pieces.longest
    alpha = np.zeros((most + 1, k))  # alpha[-1]: of all letters so far
    alpha[-1] = 1.0
    log = np.zeros(k)
    for begin in range(0, len(chars), STRETCH):
        low = max(0, begin - most + 1)
        part = chars[low : begin + STRETCH]
        h = np.zeros(len(part), np.uint64)
        ends: list[np.ndarray] = []  # by size - 1: the piece that ends at each letter
        for size in range(1, min(most, len(part)) + 1):
            h = (h[: len(part) - size + 1] + part[size - 1 :] + np.uint64(1)) * _B
            h ^= h >> np.uint64(29)
            found = np.full(len(part), -1, np.int32)
            found[size - 1 :] = pieces.find(h)
            ends.append(found)
        place = np.array(ends)[:, begin - low :]
        some = np.argwhere(place.T >= 0)  # by letter, then size
        cuts = np.searchsorted(some[:, 0], np.arange(place.shape[1] + 1)).tolist()
        sizes, probability = some[:, 1], p[place[some[:, 1], some[:, 0]]]
        for i in range(place.shape[1]):
            a, b = cuts[i], cuts[i + 1]
            now = alpha[-1] * UNKNOWN
            if b > a:
                now = now + (alpha[-1 - sizes[a:b]] * probability[a:b]).sum(axis=0)
            alpha[:-1] = alpha[1:]
            alpha[-1] = now
            if i % 8 == 7:
                most_now = alpha.max(axis=0)
                alpha /= most_now
                log += np.log(most_now)
    return log + np.log(alpha[-1])


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length: their places, and their letters with the marker in front."""
    lengths = np.array([len(w) >> 2 for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        each = max(1, min(20_000, 1_000_000 // n))
        for i in range(0, len(at), each):
            some = at[i : i + each]
            letters = np.frombuffer(b"".join(words[j] for j in some), np.uint32).reshape(len(some), n)
            yield some, np.hstack([np.full((len(some), 1), MARK, np.uint64), letters.astype(np.uint64)])


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # pieces x languages

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at, chars in by_length(words):
            if chars.shape[1] <= LONGEST + 1:
                out[at] = _forward(pieces(), chars, self.p)
            else:
                out[at] = [_forward_long(pieces(), c, self.p) for c in chars]
        return out


_pieces: Pieces | None = None


def pieces() -> Pieces:
    global _pieces
    if _pieces is None:
        _pieces = Pieces.load()
    return _pieces


def fit(words: list[tuple[str, str, int]], rounds: int = ROUNDS, smooth: float = SMOOTH) -> Model:
    """Piece probabilities by EM from (language, word, count)."""
    languages = sorted({x[0] for x in words})
    place = {l: i for i, l in enumerate(languages)}
    distinct = sorted({w for _, w, _ in words})
    index = {w: i for i, w in enumerate(distinct)}
    counts = np.zeros((len(distinct), len(languages)))
    for l, w, n in words:
        counts[index[w], place[l]] += n
    v = len(pieces().hashes)
    p = np.full((v, len(languages)), 1.0 / v)
    raw = [w.encode("utf-32-le", "surrogatepass") for w in distinct]
    for _ in range(rounds):
        expected = np.zeros_like(p)
        for at, chars in by_length(raw):
            _forward(pieces(), chars, p, counts[at], expected)
        p = (expected + smooth) / (expected.sum(axis=0) + smooth * v)
    return Model(languages, p)


def held_out(doc_id=None):
    """crc32 of doc_id as text, mod 4, is 2. A null id is held out: nothing is learned from it."""
    return F.coalesce(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")) % 4 == 2, F.lit(True))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.small_batches(whole, "text", SLICE):
            langs = np.array(batch.column("lang").to_pylist(), object)
            coded, first = words_of(batch.column("text").to_pylist())
            index, words = coded.indices.to_numpy(), [w.decode("utf-32-le", "surrogatepass") for w in coded.dictionary.to_pylist()]
            per_word = np.repeat(np.arange(len(langs)), np.diff(first))
            short = np.fromiter((len(w) <= LONGEST for w in words), bool, len(words))
            for l in sorted(set(langs)):
                n = np.bincount(index[(langs == l)[per_word]], minlength=len(words))
                at = np.flatnonzero((n > 0) & short)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array([words[i] for i in at], pa.string()), pa.array(n[at])], names=["lang", "word", "n"])
    common.give_back()


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` documents at most of each language: those with a label whose doc_id isn't held out."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("text").alias("n")).collect() if r["n"]}
    if not counts:
        return Model([], np.zeros((0, 0)))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    wanted = docs.sparkSession.createDataFrame([(l, min(1.0, sample / n)) for l, n in counts.items()], "lang string, wanted double")  # a row for each language
    some = labelled.filter(F.col("text").isNotNull()).join(F.broadcast(wanted), "lang").filter(share < F.col("wanted"))
    words = some.select("doc_id", "lang", "text").mapInArrow(_count_batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    often = words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))).filter(F.col("rank") <= WORDS)
    return fit([(r["lang"], r["word"], r["n"]) for r in often.toLocalIterator()] or [])


_known: dict[str, tuple[dict[bytes, int], np.ndarray]] = {}


class Judge:
    """Scores texts with one model; a worker keeps the scores of words it has seen, up to KEEP."""

    def __init__(self, model: Model, key: str):
        self.model, k = model, len(model.languages)
        common.hold("words", _known.clear)
        if key not in _known:
            _known.clear()
            _known[key] = ({}, np.zeros((KEEP, k), np.float32))
        self.places, self.table = _known[key]

    def _words(self, words: list[bytes]) -> np.ndarray:
        scores = np.zeros((len(words), len(self.model.languages)))
        at = np.array([self.places.get(w, -1) for w in words], np.int64)
        scores[at >= 0] = self.table[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = self.model.word_scores([words[i] for i in new]).astype(np.float32)
            scores[new] = fresh
            n = len(self.places)
            short = [j for j, i in enumerate(new.tolist()) if len(words[i]) <= 4 * LONGEST][: KEEP - n]
            self.table[n : n + len(short)] = fresh[short]
            self.places.update({words[new[j]]: n + m for m, j in enumerate(short)})
        return scores

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        coded, first = words_of(texts)
        has = np.diff(first) > 0
        k = len(self.model.languages)
        if not k or not has.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        total = np.zeros((len(texts), k))
        scores = self._words(coded.dictionary.to_pylist())
        total[has] = np.add.reduceat(scores[coded.indices.to_numpy()], first[:-1][has], axis=0)
        best = total.argmax(axis=1)
        post = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, post, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of lang_pred with equal priors)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages: its size doesn't depend on the corpus
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value, key)
        for whole in batches:
            for batch in common.small_batches(whole, "text", SLICE):
                lang, score = judge.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = common.small_arrow_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The same rows and columns without those whose language is ``und`` or known with a score under ``least``."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value, key)
        for whole in batches:
            for batch in common.small_batches(whole, whole.schema.field(at).name, SLICE):
                lang, score = judge.predict(batch.column(at).to_pylist())
                yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return common.small_arrow_batches(docs).mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return predict(docs, learn(docs))
