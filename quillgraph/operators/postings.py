"""Stored postings for lexical search: a query reads the rows of its terms only.

``postings`` has a row for each (term, field, document) with the term's count and the field's length, in folders by a hash of the term and
sorted by it, so that a filter on terms prunes folders, then row groups. It grows by batches, each with folders of its own: a document that
comes again, or goes, is named in ``gone`` with the batch whose rows no longer count. Counts and mean lengths are kept as one small file.

Documents without a term count in the statistics, as in ``bm25``. Null texts are empty. Ids are unique within a batch and not null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.store import Folder
from . import search

#: Folders of a batch's postings.
SPREAD = 64


@dataclass
class Postings:
    """An index in a folder. fields: title, summary or body, of the documents' columns of these names."""

    spark: SparkSession
    folder: str
    fields: tuple[str, ...]
    id_type: str = "long"

    def __post_init__(self):
        self.at = Folder(self.spark, self.folder)

    def _state(self) -> dict | None:
        states = self.at.names("state")
        return self.at.get(f"state/{states[-1]}") if states else None

    def _read(self, name: str, batches: list[int], schema: str) -> DataFrame | None:
        """The rows of these batches. Folders that a batch doesn't have were empty."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{b}").withColumn("batch", F.lit(b)) for b in batches if f"{b}" in self.at.names(name)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _lengths(self, batches: list[int]) -> DataFrame | None:
        """id, batch, lengths and title of the documents that count."""
        schema = f"id {self.id_type}, title string, " + ", ".join(f"len_{f} int" for f in self.fields)
        docs = self._read("docs", batches, schema)
        gone = self._read("gone", batches, f"id {self.id_type}, of int")
        return docs if gone is None or docs is None else docs.join(gone.select("id", F.col("of").alias("batch")), ["id", "batch"], "left_anti")

    def add(self, docs: DataFrame, removed: DataFrame | None = None) -> None:
        """Documents (id and the fields) that are new or come again, and ids (id) of those that go. Only what this batch changes is written."""
        before = self._state() or {"batch": 0, "batches": [], "n": 0, "sums": dict.fromkeys(self.fields, 0)}
        batch = before["batch"] + 1
        texts = {f: tokens(F.coalesce(F.col(f), F.lit(""))) for f in self.fields}
        title = F.lower("title") if "title" in self.fields else F.lit(None).cast("string")
        lengths = docs.select("id", title.alias("title"), *(F.size(t).alias(f"len_{f}") for f, t in texts.items()))
        lengths.write.mode("overwrite").parquet(f"{self.folder}/docs/{batch}")
        rows = [docs.select("id", F.lit(f).alias("field"), F.explode(t).alias("term")) for f, t in texts.items()]
        counted = reduce(DataFrame.unionByName, rows).groupBy("id", "field", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        whole = self.spark.read.parquet(f"{self.folder}/docs/{batch}")
        own = reduce(lambda a, f: a.when(F.col("field") == f, F.col(f"len_{f}")), self.fields[1:], F.when(F.col("field") == self.fields[0], F.col(f"len_{self.fields[0]}")))
        rows = counted.join(whole, "id").select("term", "field", "id", "tf", own.alias("len"), F.pmod(F.xxhash64("term"), F.lit(SPREAD)).cast("int").alias("spread"))
        # Rows of a frequent term may be many: a rebalanced exchange splits them among tasks.
        rows.hint("rebalance", "spread").sortWithinPartitions("spread", "term", "field", "id").write.mode("overwrite").partitionBy("spread").parquet(f"{self.folder}/postings/{batch}")
        sums = {"n": before["n"], **before["sums"]}
        old = self._lengths(before["batches"])
        if old is not None:
            leaving = whole.select("id") if removed is None else whole.select("id").unionByName(removed.select(F.col("id").cast(self.id_type).alias("id"))).distinct()
            hit = old.join(leaving, "id", "left_semi")
            hit.select("id", F.col("batch").alias("of")).write.mode("overwrite").parquet(f"{self.folder}/gone/{batch}")
            less = self._totals(hit)
            sums = {k: v - less[k] for k, v in sums.items()}
        more = self._totals(whole)
        sums = {k: v + more[k] for k, v in sums.items()}
        self.at.put(f"state/{batch:09d}", {"batch": batch, "batches": [*before["batches"], batch], "n": sums.pop("n"), "sums": sums})

    def _totals(self, docs: DataFrame) -> dict[str, int]:
        r = docs.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(f"len_{f}"), F.lit(0)).alias(f) for f in self.fields)).first()
        return r.asDict()

    def rows(self, terms: list[str]) -> DataFrame | None:
        """The postings of these terms that count."""
        state = self._state()
        found = self._read("postings", state["batches"], f"term string, field string, id {self.id_type}, tf int, len int, spread int") if state and terms else None
        if found is None:
            return None
        spreads = [r["s"] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(SPREAD)).cast("int").alias("s")).collect()]
        found = found.filter(F.col("spread").isin(*spreads) & F.col("term").isin(*terms))
        gone = self._read("gone", state["batches"], f"id {self.id_type}, of int")
        return found if gone is None else found.join(gone.select("id", F.col("of").alias("batch")), ["id", "batch"], "left_anti")

    def search(self, query: str, limit: int | None = 10) -> DataFrame:
        """id and score, as ``bm25`` gives them."""
        empty = self.spark.createDataFrame([], f"id {self.id_type}, score double")
        terms = search.asked_terms(self.spark.range(1), query)
        rows = self.rows(terms)
        if rows is None:
            return empty
        state = self._state()
        df = {(r["term"], r["field"]): r["n"] for r in rows.groupBy("term", "field").agg(F.count(F.lit(1)).alias("n")).collect()}  # terms of the query times fields
        if not df:
            return empty
        n, part = F.lit(state["n"]).cast("double"), F.lit(0.0)
        for (t, f), k in df.items():
            mean = F.lit(state["sums"][f] / state["n"])
            part = F.when((F.col("term") == t) & (F.col("field") == f), search.term_score(F.col("tf"), F.lit(k), F.col("len"), mean, n, search.FIELD_WEIGHTS[f])).otherwise(part)
        scored = rows.groupBy("id").agg(F.sum(part).alias("score"))
        if phrase := search.phrase_of(query, dict.fromkeys(self.fields)):
            said = self._lengths(state["batches"]).filter(F.contains("title", F.lit(phrase))).select("id", F.lit(search.PHRASE_BOOST).alias("boost"))
            scored = scored.join(said, "id", "left").select("id", (F.col("score") * F.coalesce("boost", F.lit(1.0))).alias("score"))
        return search.best(scored, limit)

    def merge(self) -> None:
        """All batches as one; what no longer counts goes."""
        state = self._state()
        if not state or len(state["batches"]) < 2:
            return
        batch, old = state["batch"] + 1, state["batches"]
        gone = self._read("gone", old, f"id {self.id_type}, of int")
        rows = self._read("postings", old, f"term string, field string, id {self.id_type}, tf int, len int, spread int")
        if rows is not None:
            rows = rows if gone is None else rows.join(gone.select("id", F.col("of").alias("batch")), ["id", "batch"], "left_anti")
            rows.drop("batch").hint("rebalance", "spread").sortWithinPartitions("spread", "term", "field", "id").write.mode("overwrite").partitionBy("spread").parquet(f"{self.folder}/postings/{batch}")
        self._lengths(old).drop("batch").write.mode("overwrite").parquet(f"{self.folder}/docs/{batch}")
        self.at.put(f"state/{batch:09d}", state | {"batch": batch, "batches": [batch]})
        for name in ("postings", "docs", "gone"):
            for b in old:
                self.at.remove(f"{name}/{b}")
