"""Ops 7, 8 and 10 and the pipeline."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillgraph.llm import common, crf, langid, mcd


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, t in enumerate(windows) if n[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_op7_statistics(spark, odd_docs, no_docs, sf):
    assert mcd.judge(no_docs).count() == 0
    for docs in (odd_docs, common.documents(spark, sf)):
        got = Counter(tuple(r) for r in mcd.statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
        assert got == Counter((r["doc_id"], *plain_statistics(r["text"])) for r in docs.collect())


def test_op7_rejects_outliers_of_a_source_and_keeps_the_rest(spark):
    rng = np.random.default_rng(1)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnop"), k))
    docs = [(i, " ".join(word(int(rng.integers(2, 9))) for _ in range(int(rng.lognormal(5.3, 0.5)) + 60)), "en", "big" if i % 3 else f"s{i % 5}") for i in range(400)]
    docs += [(1000 + i, " ".join(word(5) + "###" for _ in range(200)), "en", "big") for i in range(20)]
    rows = {r["doc_id"]: r for r in mcd.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(rows[1000 + i]["kept"] for i in range(20))
    assert sum(not rows[i]["kept"] for i in range(400)) == 0


def test_op7_one_measure_alone_rejects(spark):
    rng = np.random.default_rng(2)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnop"), k))
    line = lambda n=10, k=6: " ".join(word(k) for _ in range(n))
    docs = [(i, "\n".join(line() for _ in range(20))) for i in range(200)]
    odd = {
        "words": "\n".join(line() for _ in range(300)),
        "word_length": "\n".join(line(10, 12) for _ in range(20)),
        "symbols": "\n".join(line() + " # *" for _ in range(20)),
        "dup_lines": "\n".join(["x y"] * 13 + [line(25) for _ in range(8)]),
        "repeats": "\n".join([line() for _ in range(11)] + [again + " " + word(6) for again in [line(30)] for _ in range(3)]),
    }
    docs += [(1000 + i, x) for i, x in enumerate(odd.values())]
    rows = {r["doc_id"]: r for r in mcd.judge(spark.createDataFrame([(*d, "en", "s") for d in docs], "doc_id long, text string, lang string, source string")).collect()}
    assert not any(rows[1000 + i]["base_failed"] for i in range(len(odd)))
    assert {m: rows[1000 + i]["kept"] for i, m in enumerate(odd)} == dict.fromkeys(odd, False)
    assert all(rows[i]["kept"] for i in range(200))


def measure_rows(spark, groups):
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"{m} double" for m in mcd.MEASURES))


def plain_half_log_det(x):
    c = np.cov(x.T, bias=True) * mcd.CONSISTENCY
    l = np.zeros((5, 5))
    for i, a in enumerate(mcd.MEASURES):
        for j in range(i + 1):
            v = c[i, j] - l[i, :j] @ l[j, :j]
            l[i, j] = np.sqrt(max(v, mcd.SPREAD[a] ** 2)) if i == j else v / l[j, j]
    return float(np.log(np.diag(l)).sum())


def test_op7_finds_the_least_determinant_of_small_groups(spark):
    from itertools import combinations

    rng = np.random.default_rng(5)
    groups = {}
    for k in range(4):
        x = rng.normal(0, 1, (13, 5)) * [2, 1, 2, 3, 3]
        x[:3] += rng.normal(0, 1, 5) * 3 + 25 * (k % 2 * 2 - 1)
        groups[f"g{k}"] = x
    found = {r["g"]: r for r in mcd.mcd(measure_rows(spark, groups), True).collect()}
    for g, x in groups.items():
        best = min(combinations(range(13), 10), key=lambda s: plain_half_log_det(x[list(s)]))
        assert found[g]["half_log_det"] == pytest.approx(plain_half_log_det(x[list(best)]), abs=0.02)
        assert [found[g][f"m_{m}"] for m in mcd.MEASURES] == pytest.approx(x[list(best)].mean(axis=0), abs=0.05)


def test_op7_a_quarter_of_alike_outliers(spark):
    rng = np.random.default_rng(6)
    clean = rng.normal(0, 1, (400, 5)) * [0.5, 0.1, 0.5, 0.3, 0.8] + [5.5, 1.7, 0.5, 0.5, 1]
    far = np.array([6.0, 1.9, 5.7, 0.5, 1.0])
    groups = {str(k): np.vstack((rng.normal(0, 0.01, (k, 5)) + far, clean)) for k in (20, 70, 133)}
    for row in mcd.mcd(measure_rows(spark, groups), True).collect():
        c = np.zeros((5, 5))
        for i, a in enumerate(mcd.MEASURES):
            for j, b in enumerate(mcd.MEASURES[: i + 1]):
                c[i, j] = c[j, i] = row[f"c_{a}_{b}"]
        away = far - [row[f"m_{m}"] for m in mcd.MEASURES]
        assert away @ np.linalg.solve(c, away) > mcd.CUT, row["g"]


def test_op7_tiny_groups_and_null_groups(spark):
    rng = np.random.default_rng(8)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnop"), k))
    plain = lambda: "\n".join(" ".join(word(6) for _ in range(10)) for _ in range(20))
    wild = lambda: "\n".join(["## ** $$ x"] * 60 + [plain()])
    docs = [(i, plain(), "en", f"s{i % 3}") for i in range(120)]
    docs += [(500, wild(), "en", "rare"), (501, plain(), "en", "rare2"), (502, wild(), None, None), (503, plain(), None, None), (504, plain(), None, "s1"), (505, None, None, None)]
    rows = {r["doc_id"]: r for r in mcd.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert {d: rows[d]["kept"] for d in range(500, 506)} == {500: False, 501: True, 502: False, 503: True, 504: True, 505: False}
    assert rows[500]["base_failed"] == rows[502]["base_failed"]


def test_op7_spread_is_a_floor_and_adds_nothing(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 5)) * [2, 2, 2, 0, 2]
    all_rows = mcd.starts(measure_rows(spark, {"g": x}), True).filter(f"start = {mcd.STARTS.index('all')}")
    got = all_rows.first()
    assert got["l_words_words"] ** 2 == pytest.approx(x[:, 0].var())
    assert got["l_dup_lines_dup_lines"] == pytest.approx(mcd.SPREAD["dup_lines"])


def plain_middle(values, share):
    """The bin in which the sorted bins reach a share of their count, rounded up, and the part of it that is needed."""
    bins, counts = np.unique(values, return_counts=True)
    upto, wanted = np.cumsum(counts), int(np.ceil(len(values) * share))
    i = int(np.argmax(upto >= wanted))
    return bins[i], (wanted - upto[i] + counts[i]) / counts[i]


def plain_factor(c):
    """Cholesky factor of a covariance in which no pivot is less than the measure's spread."""
    l = np.zeros_like(c)
    for i, m in enumerate(mcd.MEASURES):
        for j in range(i + 1):
            v = c[i, j] - l[i, :j] @ l[j, :j]
            l[i, j] = np.sqrt(max(v, mcd.SPREAD[m] ** 2)) if i == j else v / l[j, j]
    return l


def plain_distance(x, mean, c):
    return (np.linalg.solve(plain_factor(c), (x - mean).T) ** 2).sum(axis=0)


def plain_mcd(x):
    """Mean and covariance of the nearest share of rows whose determinant is least, from the four starts, all in memory."""
    median = lambda v: np.array([(plain_middle(np.floor(a * mcd.VALUE_BINS), 0.5)[0] + 0.5) / mcd.VALUE_BINS for a in v.T])
    med = median(x)
    s = np.maximum(1.4826 * median(np.abs(x - med)), list(mcd.SPREAD.values()))
    z = (x - med) / s
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    u = z / np.where(norm > 0, norm, 1.0)
    first = {"medians": (med, np.diag(s**2)), "signs": (med, 5 * u.T @ u / len(x) * np.outer(s, s)), "tangents": (med, 2.5 * np.tanh(z).T @ np.tanh(z) / len(x) * np.outer(s, s)), "all": (x.mean(axis=0), np.cov(x.T, bias=True).reshape(5, 5))}

    def closer(mean, c):
        bins = np.floor(np.log(plain_distance(x, mean, c) + 1e-6) * mcd.BINS)
        limit, part = plain_middle(bins, mcd.SHARE)
        w = np.where(bins < limit, 1.0, np.where(bins == limit, part, 0.0))
        mean = w @ x / w.sum()
        return mean, mcd.CONSISTENCY * ((x - mean).T * w) @ (x - mean) / w.sum()

    size = lambda e: np.log(np.diag(plain_factor(e[1]))).sum()
    ends = []
    for start in mcd.STARTS:
        now = closer(*first[start])
        for _ in range(mcd.MOST_STEPS):
            new = closer(*now)
            if not size(new) < size(now) - mcd.LEAST_GAIN / 2:
                break
            now = new
        ends.append(now)
    return min(ends, key=size)


def test_op7_verdicts_are_those_of_a_plain_version(spark, sf):
    docs = common.documents(spark, sf)
    rows = [r.asDict() for r in mcd.measures(mcd.statistics(docs)).collect()]
    x = {r["doc_id"]: np.array([r[m] for m in mcd.MEASURES]) for r in rows}
    members = {}
    for r in rows:
        for g in ((), (r["lang"],), (r["lang"], r["source"])):
            members.setdefault(g, [])
            if not r["base_failed"]:
                members[g].append(r["doc_id"])
    estimates = {}
    for g in sorted(members, key=len):  # a group's is averaged with that of the wider one
        if members[g]:
            own, n = plain_mcd(np.array([x[i] for i in members[g]])), len(members[g])
            estimates[g] = [(a * n + b * mcd.PRIOR) / (n + mcd.PRIOR) for a, b in zip(own, estimates[g[:-1]], strict=True)] if g else own
    want = {r["doc_id"]: plain_distance(x[r["doc_id"]][None], *estimates[r["lang"], r["source"]])[0] for r in rows if (r["lang"], r["source"]) in estimates}
    got = {r["doc_id"]: r for r in mcd.judge(docs).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r["distance2"] is None} == set(x) - set(want)
    assert {i: got[i]["distance2"] for i in want} == pytest.approx(want, rel=1e-6)
    assert {i: r["kept"] for i, r in got.items()} == {r["doc_id"]: not r["base_failed"] and want.get(r["doc_id"], 0) <= mcd.CUT for r in rows}
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in got.values()) < len(rows) / 5


def test_op7_plan_has_no_python(spark, sf):
    plan = mcd.judge(common.documents(spark, sf))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def enumerate_probability(word, pieces, p):
    """Sum over all segmentations, by plain recursion over the start."""
    total = [0.0] * (len(word) + 1)
    total[0] = 1.0
    for i in range(len(word)):
        total[i + 1] += total[i] * langid.UNKNOWN
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in pieces:
                total[j] += total[i] * p[pieces[word[i:j]]]
    return total[-1]


def test_forward_sums_all_segmentations():
    from quillgraph.llm.chunks import piece_processor

    sp = piece_processor(langid.MODEL)
    h = {langid.hash_of(w): w for w in {sp.id_to_piece(i).lower() for i in range(sp.vocab_size())}}
    pieces = {h[int(x)]: i for i, x in enumerate(langid.pieces().hashes.tolist())}
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    model = langid.Model(["a", "b"], p)
    words = ["der", "straße", "international", "zzzqqx", "漢字", "é"]
    got = model.word_scores([w.encode("utf-32-le") for w in words])
    want = [[np.log(enumerate_probability("▁" + w, pieces, p[:, k])) for k in (0, 1)] for w in words]
    assert np.allclose(got, want)


def test_forward_sums_of_words_of_any_length():
    rng = np.random.default_rng(1)
    n = len(langid.pieces().hashes)
    model = langid.Model(["a", "b", "c"], rng.dirichlet(np.ones(n), 3).T)
    for size in (1, 5, 40, 70):  # both ways of summing agree, and where a stretch ends makes no difference
        word = "".join(rng.choice(list("abcdeéstrü漢"), size))
        chars = np.array([ord("▁"), *map(ord, word)], np.uint64)
        short = langid._forward(langid.pieces(), chars[None], model.p)[0]
        for stretch in (1, 7, langid.STRETCH):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(langid, "STRETCH", stretch)
                assert np.allclose(langid._forward_long(langid.pieces(), chars, model.p), short)
    text = "".join(rng.choice(list("aeiourstnl"), 10_000))
    assert np.isfinite(model.word_scores([text.encode("utf-32-le")])).all()
    coded, first = langid.words_of([text, "two words"])
    assert first.tolist() == [0, 1, 3] and len(coded.dictionary[0].as_py()) == 40_000


def test_op10(spark, odd_docs, no_docs, sf):
    docs = common.documents(spark, sf)
    model = langid.learn(docs)
    rows = langid.predict(docs, model).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)
    odd = langid.predict(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and {r["lang_pred"] for r in odd if r["doc_id"] in (3, 4, 5, 8)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    assert langid.predict(no_docs, langid.learn(no_docs)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, langid.learn(no_docs)).collect()} == {"und"}
    langid.predict(odd_docs, langid.learn(odd_docs)).collect()
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {3, 4, 5, 8} & {r["doc_id"] for r in kept.collect()}


def test_marginals_are_those_of_dense_forward_backward():
    rng = np.random.default_rng(2)
    model = crf.Crf(bias=-1.5, transition=rng.normal(size=(2, 2)))
    lengths = np.array([1, 7, 30, 12])
    spots = {0: [0], 1: [0, 1, 6], 2: [3, 17, 18, 29], 3: [5]}
    doc = np.array([d for d in spots for _ in spots[d]])
    place = np.array([k for d in spots for k in spots[d]])
    e = rng.normal(size=len(doc)) * 2
    got = crf.marginals(model, lengths, doc, place, e)
    t = np.exp(model.transition)
    for d, n in enumerate(lengths):
        pot = np.column_stack((np.ones(n), np.full(n, np.exp(model.bias))))
        for k, v in zip(place[doc == d], e[doc == d], strict=True):
            pot[k, 1] = np.exp(v)
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = np.array([0.5, 0.5]) @ t * pot[0]
        for i in range(1, n):
            a[i] = a[i - 1] @ t * pot[i]
        for i in range(n - 2, -1, -1):
            b[i] = t @ (pot[i + 1] * b[i + 1])
        m = a * b
        assert np.allclose(got[doc == d], (m[:, 1] / m.sum(axis=1))[place[doc == d]])


def test_op8(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    clean = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 60))
        toxic = i % 5 == 0
        if toxic:
            for k in rng.choice(60, 4, replace=False):
                words[k] = ["vileword", "nastyone", "foulterm"][k % 3]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = crf.learn(d, l)
    rows = crf.score(d, model).collect()
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    spans = crf.toxic_spans(d, model).collect()
    assert {r["word"] for r in spans} == {"vileword", "nastyone", "foulterm"}
    text = dict(docs)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["word"] for r in spans)
    assert crf.score(odd_docs, model).count() == odd_docs.count() and crf.score(no_docs, model).count() == 0
    assert {r["score"] for r in crf.score(odd_docs, crf.learn(odd_docs, l.filter("doc_id < 0"))).collect()} == {0.0}


def test_op8_learns_from_one_text_of_a_repeated_id(spark):
    """However many rows a sampled doc_id has, the fit gets one of them, the same in any order of rows."""
    docs = [(i, f"plain words {i} " + ("vileword" if i % 5 == 0 else "quiet")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string"
    seen = []

    def counted(sample, names, halves):
        seen.append(sample.count())
        return gather(sample, names, halves)

    gather = crf._gather_windows
    repeated = docs + [(5, f"vileword again {k}") for k in range(3000)] + [(6, "quiet")] * 3000
    with pytest.MonkeyPatch.context() as m:
        m.setattr(crf, "_gather_windows", counted)
        models = [crf.learn(spark.createDataFrame(rows, schema).repartition(5), labels) for rows in (docs, repeated, repeated[::-1])]
    learned = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200))
    assert set(seen) == {learned}
    assert models[1].weights == models[2].weights and models[1].logistic.tolist() == models[2].logistic.tolist()


def test_op8_fit_takes_the_steps_of_the_likelihood_over_all_labellings():
    rng = np.random.default_rng(4)
    start = {"a": 3.5, "b": 4.0, "c": 5.0}
    x = rng.integers(-1, 3, size=(6, 5, 2)).astype(np.int32)
    labels = np.array([[-1, 0, 1, 1, 0], [1, 0, 0, 1, -1], [0, 0, 0, 0, 0], [1, -1, 0, 1, 1], [-1, -1, 1, 0, -1], [1, 1, 1, 0, 1]])
    n, width = labels.shape
    theta, bias, tr = np.array([v / 2 for _, v in sorted(start.items())]), -4.0, np.zeros((2, 2))
    size = len(theta) + 1  # with the place that stands for no feature
    g2, gb2, gt2 = np.full(len(theta), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    steps = 8
    for _ in range(steps):
        g, gb, gt = -crf.PENALTY * theta / size, 0.0, np.zeros((2, 2))
        for w in range(n):
            real = [k for k in range(width) if labels[w, k] >= 0]
            e = {k: bias + sum(theta[f] for f in x[w, k] if f >= 0) for k in real}
            pairs = [(k, k + 1) for k in real if k + 1 in e]
            ways = [dict(zip(real, y, strict=True)) for y in itertools.product((0, 1), repeat=len(real))]
            chance = np.exp([sum(e[k] * y[k] for k in real) + sum(tr[y[a], y[b]] for a, b in pairs) for y in ways])
            chance /= chance.sum()
            for y, share in [({k: labels[w, k] for k in real}, 1.0), *((y, -c) for y, c in zip(ways, chance, strict=True))]:
                for k in real:
                    gb += share * y[k] / n
                    for f in x[w, k]:
                        if f >= 0:
                            g[f] += share * y[k] / n
                for a, b in pairs:
                    gt[y[a], y[b]] += share / n
        g2, gb2, gt2 = g2 + g * g, gb2 + gb * gb, gt2 + gt * gt
        theta = theta + crf.RATE * g / np.sqrt(g2)
        bias += crf.RATE * gb / np.sqrt(gb2)
        tr = tr + 0.2 * crf.RATE * (gt - 1e-3 * tr) / np.sqrt(gt2)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(crf, "STEPS", steps)
        got = crf.fit_crf(start, x, labels)
    assert [got.weights[f] for f in sorted(start)] == pytest.approx(theta.tolist(), rel=1e-6)
    assert got.bias == pytest.approx(bias) and np.allclose(got.transition, tr)


def segmentations(word, pieces):
    """All ways to cut a word into pieces (their places) and single letters that are unknown (None)."""
    if not word:
        yield []
        return
    for rest in segmentations(word[1:], pieces):
        yield [None, *rest]
    for j in range(1, len(word) + 1):
        if word[:j] in pieces:
            for rest in segmentations(word[j:], pieces):
                yield [pieces[word[:j]], *rest]


def test_op10_fit_is_that_of_plain_expectation_maximisation():
    from quillgraph.llm.chunks import piece_processor

    sp = piece_processor(langid.MODEL)
    h = {langid.hash_of(w): w for w in {sp.id_to_piece(i).lower() for i in range(sp.vocab_size())}}
    pieces = {h[int(x)]: i for i, x in enumerate(langid.pieces().hashes.tolist())}
    words = [("en", "the", 7), ("en", "thing", 2), ("de", "die", 5), ("de", "thing", 1), ("de", "straße", 3), ("en", "漢q", 1)]
    v, smooth = len(pieces), langid.SMOOTH
    for rounds in (1, 3):
        p = {l: np.full(v, 1.0 / v) for l in ("de", "en")}
        for _ in range(rounds):
            expected = {l: np.zeros(v) for l in p}
            for l, w, n in words:
                cuts = list(segmentations("▁" + w, pieces))
                chance = np.array([np.prod([langid.UNKNOWN if i is None else p[l][i] for i in c]) for c in cuts])
                for c, share in zip(cuts, chance / chance.sum(), strict=True):
                    for i in c:
                        if i is not None:
                            expected[l][i] += n * share
            p = {l: (e + smooth) / (e.sum() + smooth * v) for l, e in expected.items()}
        model = langid.fit(words, rounds)
        assert model.languages == ["de", "en"] and np.allclose(model.p, np.column_stack([p["de"], p["en"]]), rtol=1e-6, atol=0)


def test_pipeline(spark, sf, odd_docs):
    docs = common.documents(spark, sf)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = common.stash(stage(spark, docs, sf), "p")
        assert docs.columns == columns, name
        assert before * 0.7 <= docs.count() <= before
    assert docs.filter("text is null or trim(text) = ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    odd = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        odd = common.stash(stage(spark, odd, sf), "p")
    assert odd.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def test_stages_and_spans_of_no_documents(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, ""), name)
        assert docs.schema == no_docs.schema and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
    assert crf.toxic_spans(no_docs, crf.Crf()).count() == 0


@pytest.mark.parametrize("folder", ["quillgraph"])
def test_nothing_else_imports_this_subpackage(folder):
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / folder
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"quillgraph\.llm|from \.+llm", p.read_text())]
