"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Base statistics of a text are turned into five logarithmic measures. Each (language, source) gets its minimum-covariance-determinant (MCD)
estimate: the mean and covariance of those ``SHARE`` of its rows whose covariance has the least determinant. A document is rejected if its
squared distance from its group's estimate is over ``CUT``.

Estimates. Concentration steps start from four estimates of a group: medians with median absolute deviations, spatial signs, hyperbolic
tangents of standardised measures (all three robust), and the mean and covariance of all rows. A step keeps the nearest ``SHARE`` of
the rows by Mahalanobis distance and estimates again, as long as the determinant falls; of the four ends that of the least determinant
is the group's. The same is done for each language and for all rows. A group's estimate is then averaged with its language's (which is averaged with
that of all rows), which counts as ``PRIOR`` rows more: so one rule holds for groups of every size, and a tiny one is judged by its language.

Memory and skew: a group is never gathered. Moments are partial sums; medians and the distance that bounds the nearest share come from counts
in bins, so a group of any size is a bounded number of rows. Of the bin in which the share is reached every row counts by the part that is
needed, so ties are treated alike. Estimates are joined by broadcast only if there are at most ``FEW_GROUPS``.

Rows: a null text has no words; null languages and sources are groups of their own. Documents that fail the base rules take no part in
estimates. The variance of a measure, given the measures before it, is at least the square of a fixed spread, so rows that are all alike
reject nothing for a small difference; a greater variance is taken as it is. Repeated rows count each. Equal three-word windows are found by a
64-bit hash of them within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# White space between words, and the symbols that are counted.
SPACE = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[ \t\n\x0B\f\r]+"
SYMBOL_PATTERN = r"[#*$%&|<>]"

SHARE, PRIOR, FEW_GROUPS = 0.75, 40, 20_000
#: Bins of squared distances to a factor of e, and of a measure to a unit.
BINS, VALUE_BINS = 32, 32
#: A step that lowers the logarithm of the determinant by less is the last; steps at most (each lowers it, so they end anyway).
LEAST_GAIN, MOST_STEPS = 0.02, 50
#: Squared distance beyond which a document is rejected: the 0.999 quantile of chi-squared(5).
CUT = 20.515
#: Makes the covariance of the nearest 75 % of five normal measures that of all: 0.75 / P(chi2(7) <= quantile of chi2(5) at 0.75).
CONSISTENCY = 1.412
#: Least spread of each measure. Where nothing varies, one measure alone rejects from 10 times the words, 1.6 times the word length,
#: 9 symbols to 100 words, or 29 % duplicate lines or repeated words.
SPREAD = {"words": 0.5, "word_length": 0.1, "symbols": 0.5, "dup_lines": 0.75, "repeats": 0.75}
MEASURES = list(SPREAD)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and base_failed."""
    text = F.col("text")
    base = common.texts(docs, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    trimmed = F.btrim(text, F.lit(SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    cut = base.select("doc_id", "lang", "source", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN)).alias("words"), F.regexp_count(text, F.lit(SYMBOL_PATTERN)).cast("long").alias("n_symbols"), lines.alias("lines"))
    counted = cut.select("doc_id", "lang", "source", "words", "n_symbols", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    windows = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    hashed = counted.select(*names, windows.alias("h"))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    sorted_ = hashed.select(*names, F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(none).alias("s"))
    met = F.filter(F.transform("s", lambda x, i: F.when((x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]), x["p"])), lambda p: p.isNotNull())
    repeated = sorted_.select(*names, F.sort_array(met).alias("q"))
    covered = F.aggregate(F.transform("q", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("q", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return repeated.select(*names, covered.cast("long").alias("n_repeat_words")).withColumn("base_failed", failed)


def measures(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "words": F.log(words),
        "word_length": F.log((F.col("word_chars") + 1.0) / words),
        "symbols": F.log(1.0 + 100.0 * F.col("n_symbols") / words),
        "dup_lines": F.log(1.0 + 100.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.log(1.0 + 100.0 * F.col("n_repeat_words") / words),
    })


PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[: i + 1]]
MEANS, COVARIANCES = [f"m_{a}" for a in MEASURES], [f"c_{a}_{b}" for a, b in PAIRS]
#: Starts, robust ones first: of equal determinants the first is taken.
STARTS = ("medians", "signs", "tangents", "all")


def _cov(a: str, b: str) -> Column:
    return F.col(f"c_{a}_{b}")


FACTORS = [f"l_{a}_{b}" for a, b in PAIRS]


def _factored(estimates: DataFrame, *names: str) -> DataFrame:
    """The named columns, l_a_b (the Cholesky factor of the covariance with floors) and half the logarithm of its determinant."""
    l: dict[tuple[str, str], Column] = {}
    for a, b in PAIRS:
        value = _cov(a, b)
        for k in MEASURES[: MEASURES.index(b)]:
            value = value - l[a, k] * l[b, k]
        l[a, b] = F.sqrt(F.greatest(value, F.lit(SPREAD[a] ** 2))) if a == b else value / l[b, b]
    half = reduce(lambda x, y: x + y, (F.log(l[a, a]) for a in MEASURES))
    return estimates.select(*names, *(l[p].alias(n) for p, n in zip(PAIRS, FACTORS, strict=True)), half.alias("half_log_det"))


def _few(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _middle(binned: DataFrame, keys: list[str], share: Column, name: str) -> DataFrame:
    """By keys: the bin in which the count of rows reaches a share of theirs, rounded up, and what part of that bin it takes."""
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys)
    reached = counts.select(*keys, "bin", "k", F.sum("k").over(w.orderBy("bin")).alias("upto"), F.ceil(F.sum("k").over(w) * share).alias("wanted"))
    first = reached.filter("upto >= wanted").groupBy(*keys).agg(F.min(F.struct("bin", "k", "upto", "wanted")).alias("x"))
    return first.select(*keys, F.col("x.bin").alias(name), ((F.col("x.wanted") - F.col("x.upto") + F.col("x.k")) / F.col("x.k")).alias("part"))


def _medians(values: DataFrame) -> DataFrame:
    """By g: the median of each measure (of its bin) as med_a."""
    long = values.select("g", F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.floor(F.col(a) * VALUE_BINS).cast("int").alias("bin")) for a in MEASURES])).alias("x")).select("g", "x.name", "x.bin")
    middle = _middle(long, ["g", "name"], F.lit(0.5), "at")
    of = [F.max(F.when(F.col("name") == a, (F.col("at") + 0.5) / VALUE_BINS)).alias(f"med_{a}") for a in MEASURES]
    return middle.groupBy("g").agg(*of)


def starts(rows: DataFrame, few: bool) -> DataFrame:
    """g, start, n, means and covariances of the four first estimates. Only their shapes matter, since rows are ranked by distance."""
    med = common.stash(_medians(rows), "medians")
    apart = rows.join(_few(med, few), "g").select("g", *((F.col(a) - F.col(f"med_{a}")).alias(a) for a in MEASURES))
    mad = _medians(apart.select("g", *(F.abs(a).alias(a) for a in MEASURES)))
    scales = common.stash(mad.select("g", *(F.greatest(1.4826 * F.col(f"med_{a}"), F.lit(SPREAD[a])).alias(f"s_{a}") for a in MEASURES)), "scales")
    z = apart.join(_few(scales, few), "g").select("g", *MEASURES, *((F.col(a) / F.col(f"s_{a}")).alias(f"z_{a}") for a in MEASURES))
    norm = F.sqrt(reduce(lambda x, y: x + y, (F.col(f"z_{a}") ** 2 for a in MEASURES)))
    z = z.select("*", F.when(norm > 0, norm).otherwise(F.lit(1.0)).alias("norm"))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *(F.avg(a).alias(f"d_{a}") for a in MEASURES)]
    for a, b in PAIRS:
        sums += [F.avg(F.col(a) * F.col(b)).alias(f"all_{a}_{b}"), F.avg(F.col(f"z_{a}") * F.col(f"z_{b}") / F.col("norm") ** 2).alias(f"signs_{a}_{b}"), F.avg(F.tanh(f"z_{a}") * F.tanh(f"z_{b}")).alias(f"tangents_{a}_{b}")]
    known = common.stash(z.groupBy("g").agg(*sums).join(_few(med, few), "g").join(_few(scales, few), "g"), "known")
    of = []
    for start in STARTS:
        mean = [F.col(f"med_{a}") + (F.col(f"d_{a}") if start == "all" else 0.0) for a in MEASURES]
        cov = []
        for a, b in PAIRS:
            if start == "medians":
                c = F.col(f"s_{a}") ** 2 if a == b else F.lit(0.0)
            elif start == "all":
                c = F.col(f"all_{a}_{b}") - F.col(f"d_{a}") * F.col(f"d_{b}")
            else:
                c = F.col(f"{start}_{a}_{b}") * F.col(f"s_{a}") * F.col(f"s_{b}") * (len(MEASURES) if start == "signs" else 2.5)
            cov.append(c.alias(f"c_{a}_{b}"))
        of.append(known.select("g", F.lit(STARTS.index(start)).alias("start"), "n", *(m.alias(x) for m, x in zip(mean, MEANS, strict=True)), *cov))
    return _factored(reduce(DataFrame.unionByName, of), "g", "start", "n", *MEANS, *COVARIANCES)


def _distance2() -> Column:
    """The squared distance of a row from the estimate that it is joined to."""
    y: list[Column] = []
    for a in MEASURES:
        value = F.col(a) - F.col(f"m_{a}")
        for b, solved in zip(MEASURES, y, strict=False):
            value = value - F.col(f"l_{a}_{b}") * solved
        y.append(value / F.col(f"l_{a}_{a}"))
    return reduce(lambda s, x: s + x, (x * x for x in y))


def step(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """The estimates of the nearest SHARE of each group's rows, by g and start."""
    bin_ = F.floor(F.log(_distance2() + 1e-6) * BINS).cast("int").alias("bin")
    apart = [(F.col(a) - F.col(f"m_{a}")).alias(f"d_{a}") for a in MEASURES]
    far = rows.join(_few(estimates, few), "g").select("g", "start", "n", *MEANS, *apart, bin_)
    near = far.join(_few(_middle(far, ["g", "start"], F.lit(SHARE), "limit"), few), ["g", "start"]).filter("bin <= limit")
    weight = F.when(F.col("bin") < F.col("limit"), 1.0).otherwise(F.col("part"))
    sums = [F.max("n").alias("n"), F.sum(weight).alias("w")]
    for a in MEASURES:  # n and the means are the same in all rows of a group
        sums += [F.max(f"m_{a}").alias(f"m_{a}"), F.sum(weight * F.col(f"d_{a}")).alias(f"s_{a}")]
    sums += [F.sum(weight * F.col(f"d_{a}") * F.col(f"d_{b}")).alias(f"c_{a}_{b}") for a, b in PAIRS]
    of = near.groupBy("g", "start").agg(*sums)
    shift = {a: F.col(f"s_{a}") / F.col("w") for a in MEASURES}
    means = [(F.col(f"m_{a}") + shift[a]).alias(f"m_{a}") for a in MEASURES]
    new = of.select("g", "start", "n", *means, *((CONSISTENCY * (_cov(a, b) / F.col("w") - shift[a] * shift[b])).alias(f"c_{a}_{b}") for a, b in PAIRS))
    return _factored(new, "g", "start", "n", *MEANS, *COVARIANCES)


def mcd(rows: DataFrame, few: bool) -> DataFrame:
    """g, start, n, means, covariances, their factors and half_log_det: the estimate of least determinant of each g of rows (g and the measures)."""
    columns = ["g", "start", "n", *MEANS, *COVARIANCES, *FACTORS, "half_log_det"]
    first = common.stash(starts(rows, few), "starts")
    now = common.stash(step(rows, first, few), "estimates")
    made, done = [first, now], []
    for _ in range(MOST_STEPS):
        both = now.alias("a").join(_few(step(rows, now, few).alias("b"), few), ["g", "start"])
        falls = F.col("b.half_log_det") < F.col("a.half_log_det") - LEAST_GAIN / 2
        chosen = [F.when(falls, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns[2:]]
        both = common.stash(both.select("g", "start", *chosen, falls.alias("falls")), "estimates")
        made.append(both)
        done.append(both.filter("not falls").select(*columns))
        now = both.filter("falls").select(*columns)
        if not now.head(1):
            break
    else:
        done.append(now)
    best = F.min_by(F.struct(*columns[1:]), F.struct("half_log_det", "start")).alias("x")
    out = common.stash(reduce(DataFrame.unionByName, done).groupBy("g").agg(best).select("g", "x.*"), "estimates")
    common.discard(*made)
    return out


def _shrunk(own: DataFrame, wider: DataFrame) -> DataFrame:
    """own (with ``up``, the g of the wider group) averaged with the wider group's estimate, which counts as PRIOR rows."""
    w = wider.select(F.col("g").alias("up"), *(F.col(c).alias(f"w_{c}") for c in MEANS + COVARIANCES))
    return own.join(w, "up").select("g", "n", *(((F.col(c) * F.col("n") + F.col(f"w_{c}") * PRIOR) / (F.col("n") + PRIOR)).alias(c) for c in MEANS + COVARIANCES))


def _name(c: str) -> Column:
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: base statistics, base_failed, kept and the squared robust distance (null where its group has no estimate)."""
    keys = {"of_lang": F.concat(F.lit("lang "), _name("lang")), "of_source": F.concat(F.lit("source "), _name("lang"), F.lit(" "), _name("source"))}
    stats = common.stash(measures(statistics(docs)).withColumns(keys), "stats")
    used = stats.filter(~F.col("base_failed"))
    groups = common.stash(used.select("of_lang", "of_source").distinct(), "groups")
    few = groups.count() <= FEW_GROUPS
    rows = used.select(F.explode(F.array(F.lit("all"), "of_lang", "of_source")).alias("g"), *MEASURES)
    found = mcd(rows, few)
    everything = found.filter("g = 'all'")
    languages = _shrunk(found.join(groups.select(F.col("of_lang").alias("g")).distinct(), "g").withColumn("up", F.lit("all")), everything)
    sources = _shrunk(found.join(groups.select(F.col("of_source").alias("g"), F.col("of_lang").alias("up")), "g"), languages)
    final = common.stash(_factored(sources.withColumnRenamed("g", "of_source"), "of_source", *MEANS), "estimates")
    far = stats.join(_few(final, few), "of_source", "left").withColumn("d2", _distance2())
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(True))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance2"))


def op7_mcd_quality(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
