"""Lexical search, vector search and their fusion over tables of texts and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, stem, tokens, words

# Fixed values of the ranking formulas.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 3.0, "summary": 2.0, "body": 1.0}
PHRASE_BOOST, FUSION_K = 1.5, 60


def query_terms(query: Column) -> Column:
    return F.array_distinct(tokens(query))


def asked_terms(docs: DataFrame, query: str) -> list[str]:
    return docs.sparkSession.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]


def term_score(tf: Column, df: Column, length: Column, average: Column, n: Column, weight: float) -> Column:
    """What a term adds to a document's score: its count and the length of the field there, the documents that have it in the field, of n."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    usual = F.when(average > 0, average).otherwise(1.0)
    return F.when(tf > 0, weight * idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / usual))).otherwise(0.0)


def phrase_of(query: str, fields: dict[str, str]) -> str | None:
    """The text that raises a score where the title holds it."""
    phrase = query.strip().lower()
    return phrase if "title" in fields and len(phrase) > 2 else None


def best(scored: DataFrame, limit: int | None) -> DataFrame:
    out = scored.filter("score > 0")
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def bm25(docs: DataFrame, id_col: str, query: str, fields: dict[str, str], limit: int | None = 10) -> DataFrame:
    """id and score of the documents that have a term of the query, best first. fields: title, summary or body -> column.

    One pass over the texts: words become rows that are counted by document within their task, so what is shuffled is one row of counts for
    each document; both the statistics and the scores read that one exchange. For many queries over the same texts see ``postings``.
    """
    terms = asked_terms(docs, query)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).filter(F.lit(False))
    phrase = phrase_of(query, fields)
    per_field = []
    for i, (f, c) in enumerate(fields.items()):
        said = F.contains(F.lower(F.col(c)), F.lit(phrase)) if phrase and f == "title" else F.lit(False)
        found = docs.select(F.col(id_col).alias("id"), said.alias("said"), F.explode_outer(words(F.coalesce(F.col(c), F.lit("")))).alias("w"))
        kept = (F.length("w") > 1) & ~F.col("w").isin(*STOP_WORDS)
        per_field.append(found.select("id", "said", F.lit(i).alias("field"), F.when(kept, stem(F.col("w"))).alias("w")))
    sums = [F.max("said").alias("said")]
    for i, f in enumerate(fields):
        here = F.col("field") == i
        sums += [F.count(F.when(here, F.col("w"))).alias(f"len_{f}"), *(F.count(F.when(here & (F.col("w") == t), 1)).alias(f"tf_{f}_{k}") for k, t in enumerate(terms))]
    counted = reduce(DataFrame.unionByName, per_field).groupBy("id").agg(*sums)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields), *(F.sum((F.col(f"tf_{f}_{i}") > 0).cast("long")).alias(f"df_{f}_{i}") for f in fields for i in range(len(terms))))
    scored = counted.filter(reduce(lambda a, b: a | b, [F.col(f"tf_{f}_{i}") > 0 for f in fields for i in range(len(terms))])).crossJoin(F.broadcast(stats))  # stats: one row
    parts = [term_score(F.col(f"tf_{f}_{i}"), F.col(f"df_{f}_{i}"), F.col(f"len_{f}"), F.col(f"avg_{f}"), F.col("n"), FIELD_WEIGHTS[f]) for f in fields for i in range(len(terms))]
    score = reduce(lambda a, b: a + b, parts)
    if phrase:
        score = score * F.when(F.col("said"), PHRASE_BOOST).otherwise(1.0)
    return best(scored.select("id", score.alias("score")), limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of different length are an error."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")).cast("double")).otherwise(dot(a, b))
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(checked / F.nullif(norm, F.lit(0.0)))


def vector_rank(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], limit: int = 50) -> DataFrame:
    """id and score of the nearest vectors with a positive cosine: an exact scan with a bounded top-k in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def fuse(rankings: list[DataFrame], limit: int = 10, k: int = FUSION_K, depth: int = 1000) -> DataFrame:
    """Reciprocal rank fusion of rankings (id, score): id, score and how many of them have it. Of each the best ``depth`` count, so the window
    that numbers them has no more rows."""
    w = Window.orderBy(F.desc("score"), "id")
    parts = [r.orderBy(F.desc("score"), "id").limit(depth).select("id", F.row_number().over(w).alias("rank")) for r in rankings]
    one = reduce(DataFrame.unionByName, parts)
    return one.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("sources")).orderBy(F.desc("score"), "id").limit(limit)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / F.nullif(n, F.lit(0.0))))


def pooled(vectors: DataFrame, key: str, vector_col: str) -> DataFrame:
    """key and the mean direction of its vectors: sums by (key, dimension), partial before the shuffle."""
    by_dim = vectors.select(key, F.posexplode(unit(F.col(vector_col))).alias("d", "x")).groupBy(key, "d").agg(F.sum("x").alias("x"))
    gathered = by_dim.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return gathered.select(key, unit(F.col("v")).alias("vector"))


def node_scores(chunks: DataFrame, key: str, vector_col: str, query: list[float], mode: str = "best") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    if mode == "pooled":
        return pooled(chunks, key, vector_col).select(key, cosine(F.col("vector"), q).alias("score"))
    return chunks.groupBy(key).agg(F.max(cosine(F.col(vector_col), q)).alias("score"))


def nearest_name(names: DataFrame, column: str, wanted: str) -> DataFrame:
    """The candidate with the least edit distance, first by name among equals."""
    d = F.levenshtein(F.col(column), F.lit(wanted))
    return names.agg(F.min_by(column, F.struct(d.alias("d"), F.col(column).alias("n"))).alias("name"), F.min(d).alias("distance"))
