"""Toxic spans by a linear-chain conditional random field (CRF), and document scores from its marginals.

Labels are given for documents. Token labels come from them: a word form, prefix or suffix that is far more frequent in toxic than in
clean documents of the sample names toxic words, and such a word is labelled toxic in toxic documents and clean in clean ones. The CRF has
two states, a weight for each such feature, a bias and transitions, and is fitted on windows of those labelled tokens by gradient steps on
its likelihood. A token without any such feature is neutral; all neutral tokens share their potentials, so a stretch of them is
a power of one 2x2 matrix. Forward-backward therefore steps over the other tokens alone, and is exact on whole texts of any length.

The score is a logistic function, fitted on the sample with the classes' true shares, of the marginals: their largest, their sum, and their
sum per word. Everything is learned from at most about ``SAMPLE`` documents of each class whose crc32(doc_id) mod 4 isn't 2, picked by a hash of
doc_id: their whole texts are read where they are, and the driver gets the ``FEATURES`` strongest features, at most ``WINDOWS`` + 1 windows of a
document for the likelihood, and a few numbers for each. Scores read whole texts. lang, source and doc_id are no input of a score.

Rows: a null or empty text scores like one without toxic words. A null doc_id is held out. A doc_id with several labels is toxic if
one of them says so. Without labels of both classes every score is 0. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import held_out, words_of

#: The fit is bounded: labelled documents of each class, features, and windows of a document that the likelihood sees.
SAMPLE, FEATURES, WINDOWS = 2000, 20_000, 10
LEAST, RATIO = 6, 3.0
WINDOW, STEPS, RATE, PENALTY = 6, 100, 0.5, 1e-3
THRESHOLD = 0.3
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def features(word: str) -> list[str]:
    out = ["w" + word]
    for n in (4, 5, 6):
        if len(word) > n:
            out.append("p" + word[:n])
    if len(word) > 5:
        out.append("s" + word[-5:])
    return out


@dataclass
class Crf:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: np.ndarray | None = None

    def emission(self, word: str) -> float | None:
        """Log-potential of the toxic state against the other; None for a neutral word."""
        found = [w for f in features(word) if (w := self.weights.get(f)) is not None]
        return self.bias + sum(found) if found else None


def marginals(model: Crf, lengths: np.ndarray, doc: np.ndarray, place: np.ndarray, emission: np.ndarray) -> np.ndarray:
    """P(toxic) of the tokens that aren't neutral, given by (doc, place in it, emission) in order, in texts of these lengths."""
    if not len(doc):
        return np.zeros(0)
    t = np.exp(model.transition)
    neutral = t * np.array([1.0, np.exp(model.bias)])
    values, vectors = np.linalg.eig(neutral)
    order = np.argsort(-values.real)
    values, vectors = values.real[order], vectors.real[:, order]
    inverse = np.linalg.inv(vectors)
    first, second = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])
    shrink = values[1] / values[0]

    def stretch(n: np.ndarray) -> np.ndarray:  # neutral ** n, scaled
        return first + shrink ** n[:, None, None] * second

    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    counts = np.diff(np.append(starts, len(doc)))
    own = np.exp(np.clip(emission, -30, 30))
    before = np.empty(len(doc), np.int64)  # neutral tokens right before
    before[0] = place[0]
    before[1:] = place[1:] - place[:-1] - 1
    before[starts] = place[starts]
    after = lengths[doc[starts]] - 1 - place[starts + counts - 1]
    alpha, beta = np.empty((len(doc), 2)), np.empty((len(doc), 2))
    by_size = np.argsort(-counts, kind="stable")
    s, c = starts[by_size], counts[by_size]
    now = np.full((len(s), 2), 0.5)
    for k in range(int(c[0])):
        n = int(np.searchsorted(-c, -k, side="left"))
        at = s[:n] + k
        v = np.einsum("ni,nij->nj", now[:n], stretch(before[at])) @ t
        v[:, 1] *= own[at]
        v /= v.sum(axis=1, keepdims=True)
        now[:n] = alpha[at] = v
    back = stretch(after[by_size]).sum(axis=2)
    for k in range(int(c[0])):
        n = int(np.searchsorted(-c, -k, side="left"))
        at = s[:n] + c[:n] - 1 - k
        v = back[:n] / back[:n].sum(axis=1, keepdims=True)
        beta[at] = v
        u = v.copy()
        u[:, 1] *= own[at]
        back[:n] = np.einsum("nij,nj->ni", stretch(before[at]), u @ t.T)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


def active_tokens(model: Crf, words: list[str], index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, emission, place among all words) of the words that aren't neutral."""
    of_word = np.array([np.nan if (e := model.emission(w)) is None else e for w in words]) if words else np.zeros(0)
    e = of_word[index] if len(index) else np.zeros(0)
    at = np.flatnonzero(~np.isnan(e))
    doc = np.searchsorted(first, at, side="right") - 1
    return doc, at - first[doc], e[at], at


def summary(n: int, lengths: np.ndarray, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By text: 1, largest marginal, log(1 + sum), sum per word."""
    most, total = np.zeros(n), np.zeros(n)
    np.maximum.at(most, doc, p)
    np.add.at(total, doc, p)
    return np.column_stack((np.ones(n), most, np.log1p(total), 20.0 * total / np.maximum(lengths, 1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


#: Feature counts of the sample's documents: by half of it, and by class.
COUNTS = "feature string, clean_0 long, toxic_0 long, clean_1 long, toxic_1 long"


def _words(batch: pa.RecordBatch) -> list[list[str]]:
    coded, first = words_of(batch.column("text").to_pylist())
    words = [w.decode("utf-32-le", "surrogatepass") for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy()
    return [[words[i] for i in index[a:b].tolist()] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for whole in batches:
        for batch in common.small_batches(whole, "text"):
            seen: dict[str, list[int]] = {}
            for words, half, y in zip(_words(batch), batch.column("half").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f in {f for w in set(words) for f in features(w)}:
                    seen.setdefault(f, [0, 0, 0, 0])[2 * half + y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in range(4))], names=names)


def toxic_features(counts: DataFrame, halves: tuple[int, ...], most: int = FEATURES) -> dict[str, float]:
    """Features whose rate in toxic documents of these halves is far over that in clean ones, and its logarithm: the ``most`` strongest."""
    n = counts.filter("feature = ''").first()  # all documents
    clean, toxic = (sum((F.col(f"{c}_{h}") for h in halves), F.lit(0)) for c in ("clean", "toxic"))
    n0, n1 = (sum(n[f"{c}_{h}"] for h in halves) for c in ("clean", "toxic"))
    ratio = F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))
    found = counts.filter((F.col("feature") != "") & (toxic >= LEAST)).select("feature", ratio.alias("r")).filter(F.col("r") >= RATIO)
    return {r["feature"]: r["r"] for r in found.orderBy(F.desc("r"), "feature").limit(most).collect()}


def _windows(words: list[str], y: int, place: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(step x feature places, label of each step, -1 for none) of at most WINDOWS windows around tokens with a toxic feature, spread over the text, and one in its middle."""
    width = 2 * WINDOW + 1
    known: dict[str, list[int]] = {}
    found = [known[w] if w in known else known.setdefault(w, [place[f] for f in features(w) if f in place]) for w in words]
    hits = [i for i, x in enumerate(found) if x]
    chosen = [hits[k * len(hits) // WINDOWS] for k in range(WINDOWS)] if len(hits) > WINDOWS else hits
    out = []
    for c in chosen + [len(words) // 2] * bool(words):
        r, label = np.full((width, 5), -1, np.int32), np.full(width, -1, np.int8)
        for k, i in enumerate(range(c - WINDOW, c + WINDOW + 1)):
            if 0 <= i < len(words):
                r[k, : len(found[i])] = found[i]
                label[k] = bool(found[i]) and int(y)
        out.append((r, label))
    return out


def _gather_windows(sample: DataFrame, names: list[str], halves: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all documents of these halves: at most WINDOWS + 1 of a document, each of a fixed number of bytes."""
    sent = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.small_batches(whole, "text"):
                rows = [(x.tobytes(), y.tobytes()) for words, toxic in zip(_words(batch), batch.column("toxic").to_pylist(), strict=True) for x, y in _windows(words, toxic, sent.value)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(2)], names=["x", "y"])

    rows = sample.filter(F.col("half").isin(*halves)).mapInArrow(run, "x binary, y binary").collect()
    pairs = sorted((bytes(r["x"]), bytes(r["y"])) for r in rows)  # so that the sums don't depend on the tasks' order
    width = 2 * WINDOW + 1
    x = np.frombuffer(b"".join(a for a, _ in pairs), np.int32).reshape(-1, width, 5)
    return x, np.frombuffer(b"".join(b for _, b in pairs), np.int8).reshape(-1, width).astype(np.int64)


def fit_crf(start: dict[str, float], x: np.ndarray, labels: np.ndarray) -> Crf:
    """Gradient steps on the likelihood of windows (feature places by step, in the sorted order of ``start``; labels, -1: no token)."""
    names = sorted(start)
    if not names or not len(x):
        return Crf()
    real, y = labels >= 0, np.maximum(labels, 0)
    n, width, _ = x.shape
    theta = np.array([start[f] / 2 for f in names] + [0.0])  # the last stands for no feature
    bias, tr = -4.0, np.zeros((2, 2))
    g2, gb2, gt2 = np.full(len(theta), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    pairs = real[:, 1:] & real[:, :-1]
    for _ in range(STEPS):
        e = np.where(real, bias + theta[x].sum(axis=2), 0.0)
        t = np.exp(tr)
        alpha, beta = np.ones((width, n, 2)), np.ones((width, n, 2))
        for k in range(width):
            v = np.ones((n, 2)) if k == 0 else np.where(pairs[:, k - 1, None], alpha[k - 1] @ t, 1.0)
            v[:, 1] *= np.exp(e[:, k])
            alpha[k] = v / v.sum(axis=1, keepdims=True)
        for k in range(width - 2, -1, -1):
            u = beta[k + 1].copy()
            u[:, 1] *= np.exp(e[:, k + 1])
            v = np.where(pairs[:, k, None], u @ t.T, 1.0)
            beta[k] = v / v.sum(axis=1, keepdims=True)
        both = alpha * beta
        p = (both[..., 1] / both.sum(axis=2)).T
        grad_e = np.where(real, y - p, 0.0) / n
        g = np.zeros(len(theta))
        np.add.at(g, x, grad_e[:, :, None])
        g = g - PENALTY * theta / len(theta)
        g[-1] = 0.0
        gt = np.zeros((2, 2))
        for k in range(width - 1):
            u = beta[k + 1].copy()
            u[:, 1] *= np.exp(e[:, k + 1])
            joint = alpha[k][:, :, None] * t * u[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            use = pairs[:, k]
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[use, k], y[use, k + 1]), 1.0)
            gt += (seen - joint[use].sum(axis=0)) / n
        gb = grad_e.sum()
        g2, gb2, gt2 = g2 + g * g, gb2 + gb * gb, gt2 + gt * gt
        theta = theta + RATE * g / np.sqrt(g2)
        theta[-1] = 0.0
        bias += RATE * gb / np.sqrt(gb2)
        tr = tr + 0.2 * RATE * (gt - 1e-3 * tr) / np.sqrt(gt2)
    return Crf({f: float(w) for f, w in zip(names, theta, strict=False)}, float(bias), tr)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """Fits on about ``sample`` labelled documents at most of each class that aren't held out, and on one text of each."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Crf()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    picked = known.filter(F.when(F.col("toxic") == 1, share < min(1.0, sample / sizes[1])).otherwise(share < min(1.0, sample / sizes[0])))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    # About 2 * sample rows, by the shares: small enough to be broadcast. Their texts stay where they are, in a shared table.
    # Of a doc_id that several rows have, one text is learned from (that of the least hash): one row a doc_id, however often it is repeated.
    one = common.texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample_rows = common.stash(one.select("text", "toxic", half), "sample")
    counted = sample_rows.mapInArrow(_count_batches, COUNTS)
    sums = [F.sum(c.split()[0]).alias(c.split()[0]) for c in COUNTS.split(", ")[1:]]
    everything = sample_rows.select(F.lit("").alias("feature"), *(((F.col("half") == h) & (F.col("toxic") == y)).cast("long").alias(f"{n}_{h}") for h in (0, 1) for y, n in enumerate(("clean", "toxic"))))
    counts = common.stash(counted.unionByName(everything).groupBy("feature").agg(*sums), "features")
    if not counts.filter("feature = ''").filter("clean_0 + clean_1 > 0 and toxic_0 + toxic_1 > 0").head(1):
        return Crf()

    def fitted(halves: tuple[int, ...]) -> Crf:
        start = toxic_features(counts, halves)
        return fit_crf(start, *_gather_windows(sample_rows, sorted(start), halves)) if start else Crf()

    # The logistic function sees marginals of documents that the field behind them wasn't fitted on: each half's from the other half's.
    others = sample_rows.sparkSession.sparkContext.broadcast([fitted((1,)), fitted((0,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.small_batches(whole, "text"):
                of = batch.column("half").to_numpy()
                x = [_summary_batch(m, batch.column("text").to_pylist()) for m in others.value]
                own = np.where((of == 0)[:, None], x[0], x[1])
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(np.ascontiguousarray(c)) for c in own.T)], names=["toxic", "one", "most", "log_sum", "share"])

    seen = sample_rows.mapInArrow(run, "toxic int, one double, most double, log_sum double, share double").orderBy("toxic", "most", "log_sum", "share").collect()  # five numbers a document
    toxic, x = np.array([r["toxic"] for r in seen]), np.array([list(r)[1:] for r in seen])
    weight = np.where(toxic == 1, sizes[1] / toxic.sum(), sizes[0] / (toxic == 0).sum())
    model = fitted((0, 1))
    model.logistic = fit_logistic(x, toxic, weight * len(toxic) / weight.sum())
    common.discard(sample_rows, counts)
    return model


def _summary_batch(model: Crf, texts: list[str]) -> np.ndarray:
    """By text, what the logistic function sees."""
    coded, first = words_of(texts)
    words = [w.decode("utf-32-le", "surrogatepass") for w in coded.dictionary.to_pylist()]
    doc, place, e, _ = active_tokens(model, words, coded.indices.to_numpy(), first)
    return summary(len(texts), np.diff(first), doc, marginals(model, np.diff(first), doc, place, e))


def _score_batch(model: Crf, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """scores, and (text, place among all words, marginal) of the words that aren't neutral."""
    n = len(texts)
    coded, first = words_of(texts)
    words = [w.decode("utf-32-le", "surrogatepass") for w in coded.dictionary.to_pylist()]
    lengths = np.diff(first)
    doc, place, e, _ = active_tokens(model, words, coded.indices.to_numpy(), first)
    p = marginals(model, lengths, doc, place, e)
    score = sigmoid(summary(n, lengths, doc, p) @ model.logistic) if model.logistic is not None else np.zeros(n)
    return score, doc, place, p



def score(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its features come from the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in common.small_batches(whole, "text"):
                s, *_ = _score_batch(m, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return common.texts(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCORED)


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code-point offsets in the text of the words that words_of finds in it lower-cased, where some characters become several."""
    low = text.lower()
    origin = range(len(text)) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    out, start = [], None
    for i, c in enumerate(low + " "):
        if c.isalpha():
            start = i if start is None else start
        elif start is not None:
            out.append((origin[start], origin[i - 1] + 1))
            start = None
    return out


def toxic_spans(docs: DataFrame, model: Crf, least: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points), marginal and word of every token that is toxic with probability ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in common.small_batches(whole, "text"):
                texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
                _, doc, place, p = _score_batch(m, texts)
                rows, offsets = [], {}
                for d, k, q in zip(doc.tolist(), place.tolist(), p.tolist(), strict=True):
                    if q >= least:
                        if d not in offsets:
                            offsets = {d: word_offsets(texts[d])}
                        a, b = offsets[d][k]
                        rows.append((ids[d], a, b, q, texts[d][a:b].lower()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64()] * 3 + [pa.float64(), pa.string()], strict=True)], names=["doc_id", "start", "end", "marginal", "word"])

    return common.texts(docs).mapInArrow(run, "doc_id long, start long, end long, marginal double, word string")


def op8_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
