"""A stored graph that follows its notes: only what changed is parsed, resolved, embedded and written.

A table of the mirror lies in parts by a hash of its key, and a manifest says which generation each part is of. A sync writes new
generations of the parts that changed, then the manifest, by one rename: a reader sees the state before or after, and a broken write is
never read. Parts that no manifest of the last two names are removed.

``notes`` has path and hash of each note, ``edges`` its edge lines as parsed, ``graph`` these with the node each link means now, ``vectors`` a
vector for each different text. A note that comes, changes or goes may give or take the meaning of other notes' links: those whose
name is an ending of its path. They are resolved again with it, and nothing else is.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.retrieval import embed_hashed
from ..sources.notes import link_names, parsed_edges, path_ends, resolve_links
from ..sources.store import Folder

#: Stored tables of another format are not read but built anew.
FORMAT = 2
PARTS = 64


def upsert(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """notes (path, text) with the changed ones in place of those of the same path."""
    return notes.join(changed, "path", "left_anti").unionByName(changed)


def remove(notes: DataFrame, paths: DataFrame) -> DataFrame:
    return notes.join(paths, "path", "left_anti")


def rename(notes: DataFrame, old: str, new: str) -> DataFrame:
    """Links by the old name lead to a stub from then on, as after a removal."""
    return notes.withColumn("path", F.when(F.col("path") == old, F.lit(new)).otherwise(F.col("path")))


def hashed(notes: DataFrame) -> DataFrame:
    return notes.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))


def resolved(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges with the node that their link means now, or a stub."""
    return resolve_links(edges, paths.select("path")).withColumns({"target_id": F.coalesce("to", "target"), "stub": F.col("to").isNull()})


class Mirror:
    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self.at = Folder(spark, self.folder)

    # Generations

    def manifest(self, back: int = 0) -> dict | None:
        """The latest one of this format, or one of those before it."""
        names = self.at.names("manifest")
        found = self.at.get(f"manifest/{names[-1 - back]}") if len(names) > back else None
        return found if found and found["format"] == FORMAT else None

    def state(self) -> tuple[str | None, bool]:
        """The latest complete generation, and whether a later one was begun and not completed."""
        done, now = self.at.names("manifest"), self.manifest()
        return (now["generation"] if now else None), any(b > (done[-1] if done else "") for b in self.at.names("begun"))

    def begin(self) -> str:
        last = max([*self.at.names("manifest"), *self.at.names("begun"), "0"])
        generation = f"{int(last.partition('-')[0]) + 1:09d}-{uuid.uuid4().hex}"
        self.at.put(f"begun/{generation}", {})
        return generation

    def part_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def put(self, generation: str, name: str, rows: DataFrame, key: str | None, touched: list[int] | None, manifest: dict) -> None:
        """Writes the touched parts (None: all) of a table; the rows are those of the touched parts. A table without a key is one part."""
        part = self.part_of(key) if key else F.lit(0)
        rows.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{self.folder}/{generation}/{name}")
        made = {int(n.partition("=")[2]) for n in self.at.names(f"{generation}/{name}") if n.startswith("part=")}
        old = manifest["tables"].get(name, {"at": {}})["at"]
        kept = {p: g for p, g in old.items() if touched is not None and int(p) not in touched}
        manifest["tables"][name] = {"schema": rows.schema.json(), "at": kept | {str(p): generation for p in sorted(made)}}

    def finish(self, generation: str, manifest: dict) -> None:
        self.at.put(f"manifest/{generation}", manifest | {"format": FORMAT, "generation": generation})
        live = {g for back in (0, 1) for t in ((self.manifest(back) or {}).get("tables") or {}).values() for g in t["at"].values()}
        for name in self.at.names():
            if name not in live and name not in ("manifest", "begun", generation) and not name.startswith("."):
                self.at.remove(name)
        for name in self.at.names("manifest")[:-2]:
            self.at.remove(f"manifest/{name}")
        for name in self.at.names("begun"):
            if name <= generation:
                self.at.remove(f"begun/{name}")

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Tables as wholes, in place of those of these names."""
        generation, manifest = self.begin(), self.manifest() or {"tables": {}}
        for name, df in tables.items():
            self.put(generation, name, df, None, None, manifest)
        self.finish(generation, manifest)
        return generation

    def rows_of(self, manifest: dict | None, name: str, parts: list[int] | None = None) -> DataFrame | None:
        """A table, or some parts of it, as a manifest has it."""
        table = (manifest or {"tables": {}})["tables"].get(name)
        if table is None:
            return None
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        paths = [f"{self.folder}/{g}/{name}/part={p}" for p, g in table["at"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, back: int = 0, parts: list[int] | None = None) -> DataFrame | None:
        """A table in the latest complete generation or one before; None where everything has to be built."""
        return self.rows_of(self.manifest(back), name, parts)

    # Notes

    def touched(self, *keys: DataFrame, key: str) -> list[int]:
        """The parts that hold these keys: at most as many rows as there are parts."""
        return [r["p"] for r in reduce(DataFrame.unionByName, [k.select(self.part_of(key).alias("p")) for k in keys]).distinct().collect()]

    def sync(self, notes: DataFrame, embed: Callable[[DataFrame], DataFrame] = embed_hashed, model: str = "hashed") -> str:
        """Brings the stored tables to the state of the notes (path, text). Vectors of another model are made anew."""
        generation, old = self.begin(), self.manifest() or {"tables": {}}
        manifest = {"tables": dict(old["tables"]), "model": model}
        now = hashed(notes).filter("path is not null")
        known = self.read("notes")
        first = known is None
        known = self.spark.createDataFrame([], "path string, hash string") if first else known
        both = now.join(known.select(F.col("path").alias("path"), F.col("hash").alias("old")), "path", "full_outer")
        # What changed is written once, so all that follows is of the same texts.
        delta = both.filter(~F.col("hash").eqNullSafe(F.col("old"))).select("path", "text", "hash", "old")
        delta.write.parquet(f"{self.folder}/{generation}/delta")
        delta = self.spark.read.schema(delta.schema).parquet(f"{self.folder}/{generation}/delta")
        paths, come = delta.select("path"), delta.filter("hash is not null")
        touched = None if first else self.touched(paths, key="path")

        def kept(name: str, parts: list[int] | None) -> DataFrame | None:
            rows = None if first else self.read(name, parts=parts)
            return None if rows is None else rows.join(paths, "path", "left_anti")

        def joined(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return new if old is None else old.unionByName(new)

        self.put(generation, "notes", joined(kept("notes", touched), come.select("path", "hash")), "path", touched, manifest)
        self.put(generation, "edges", joined(kept("edges", touched), parsed_edges(come)), "path", touched, manifest)
        self._graph(generation, delta, touched, manifest)
        self._vectors(generation, now, old.get("model") == model and not first, embed, manifest)
        self.at.remove(f"{generation}/delta")
        self.finish(generation, manifest)
        return generation

    def _graph(self, generation: str, delta: DataFrame, touched: list[int] | None, manifest: dict) -> None:
        """Links of changed notes, and of others that a path which came or went is an ending for, are resolved; the parts of the latter are touched too."""
        paths, edges = self.rows_of(manifest, "notes"), self.rows_of(manifest, "edges")
        if touched is None:
            self.put(generation, "graph", resolved(edges, paths), "path", None, manifest)
            return
        moved = path_ends(delta.filter("hash is null or old is null").select("path")).select("end").distinct()
        affected = link_names(edges).join(moved, F.lower("name") == F.col("end"), "left_semi").select("path").distinct()
        parts = sorted({*touched, *self.touched(affected, key="path")})
        again = delta.select("path").unionByName(affected).distinct()
        fresh = resolved(self.rows_of(manifest, "edges", parts).join(again, "path", "left_semi"), paths)
        rest = self.read("graph", parts=parts).join(again, "path", "left_anti")
        self.put(generation, "graph", rest.unionByName(fresh), "path", parts, manifest)

    def _vectors(self, generation: str, now: DataFrame, same: bool, embed: Callable[[DataFrame], DataFrame], manifest: dict) -> None:
        """Texts without a vector get one; vectors of texts that are gone go."""
        wanted = now.select("hash", "text").dropDuplicates(["hash"])
        have = self.read("vectors") if same else None
        if have is None:
            self.put(generation, "vectors", embed(wanted), "hash", None, manifest)
            return
        missing, stale = wanted.join(have, "hash", "left_anti"), have.join(wanted, "hash", "left_anti")
        touched = self.touched(missing, stale, key="hash")
        rest = self.read("vectors", parts=touched).join(stale, "hash", "left_anti")
        self.put(generation, "vectors", rest.unionByName(embed(missing)) if touched else rest, "hash", touched, manifest)

    def changes(self) -> DataFrame:
        """What the last sync did to the graph: change (insert, delete), kind (edge, stub), path, place, type and target_id. Only parts of new generations are read."""
        now, before = self.manifest(), self.manifest(1)
        then = before["tables"].get("graph", {"at": {}})["at"] if before else {}
        mine = now["tables"]["graph"]["at"]
        parts = [int(p) for p in {*mine, *then} if mine.get(p) != then.get(p)]
        columns = ["path", "place", "type", "sign", "props", "target_id", "stub"]
        after = self.read("graph", parts=parts).select(*columns)
        prior = self.read("graph", 1, parts).select(*columns) if before and "graph" in before["tables"] else after.limit(0)

        def differ(a: DataFrame, b: DataFrame, says: str) -> DataFrame:
            return a.exceptAll(b).select(F.lit(says).alias("change"), F.lit("edge").alias("kind"), "path", "place", "type", "target_id")

        def stubs(df: DataFrame, everything: DataFrame) -> DataFrame:
            return df.filter("stub").select("target_id").distinct().join(everything.filter("stub").select("target_id").distinct(), "target_id", "left_anti")

        def shown(df: DataFrame, says: str) -> DataFrame:
            return df.select(F.lit(says).alias("change"), F.lit("stub").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("type"), "target_id")

        whole = self.read("graph", 1) if before and "graph" in before["tables"] else after.limit(0)
        parts_of = [differ(after, prior, "insert"), differ(prior, after, "delete"), shown(stubs(after, whole), "insert"), shown(stubs(prior, self.read("graph")), "delete")]
        return reduce(DataFrame.unionByName, parts_of)


def wait_fresh(query, seconds: float = 3.0) -> list[str]:
    """Waits until a streaming query has taken in what has arrived, for some seconds at most; then the answer may be stale, and a notice says so."""
    until = time.monotonic() + seconds
    while query.isActive and (query.status["isDataAvailable"] or query.status["isTriggerActive"]):
        if time.monotonic() > until:
            return [f"the graph may be behind its notes: still being read after {seconds} s"]
        time.sleep(0.05)
    return []
