"""Documents, requirement files and source files as one graph: sections, requirements, scenarios and annotated code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .code import annotation_rows, scan, symbols
from .graph import EdgeTable, NodeTable, PropertyGraph
from .notes import parsed_edges
from .sections import by_text, document_keys, in_sections, references, requirements, sections, spec_names


def section_targets(links: DataFrame, known: DataFrame) -> DataFrame:
    """links (target) with ``to``: a section's id, its file and heading path, or a unique heading; null if none or several fit."""
    exact = known.select(F.col("id").alias("target"), F.col("id").alias("to"), F.lit(0).alias("tier"))
    bare = known.select(F.regexp_replace("id", r"\.md(?=#|$)", "").alias("target"), F.col("id").alias("to"), F.lit(1).alias("tier"))
    short = known.select(F.regexp_replace(F.regexp_replace("id", r"^.*/", ""), r"\.md(?=#|$)", "").alias("target"), F.col("id").alias("to"), F.lit(2).alias("tier"))
    heading = known.select(F.col("heading").alias("target"), F.col("id").alias("to"), F.lit(3).alias("tier"))
    tiers = exact.unionByName(bare).unionByName(short).unionByName(heading).distinct()
    by_tier = tiers.groupBy("target", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to"))
    best = by_tier.groupBy("target").agg(F.min_by(F.struct("n", "to"), "tier").alias("b")).filter("b.n = 1").select("target", F.col("b.to").alias("to"))
    return links.join(best, "target", "left")


def lattice_graph(spark: SparkSession, docs: DataFrame, specs: DataFrame, files: DataFrame, code: str = "annotated") -> PropertyGraph:
    """Each table is (path, text). code: off, annotated (only symbols that an annotation belongs to) or all.

    Edge lines of a document are typed edges from the section they stand in; another link from there to the same end is no ``references`` edge then. A
    first-level section refers to the requirements that its document's ``openspec`` key names. Links that lead nowhere, or to the section itself, are left out.
    """
    g = PropertyGraph(spark)
    own, parts, notes = sections(docs).persist(), requirements(specs).persist(), annotation_rows(files).persist()
    g.kept = [own, parts, notes]
    g.node_tables["Section"] = NodeTable(own, F.col("id"))
    g.node_tables["Requirement"] = NodeTable(parts.filter("scenario is null").select(F.col("requirement").alias("id"), F.col("line").alias("at")), F.col("id"))
    g.node_tables["Scenario"] = NodeTable(parts.filter("scenario is not null").select(F.col("scenario").alias("id"), F.col("line").alias("at")), F.col("id"))
    g.edge_tables["contains"] = [
        EdgeTable(own.filter("parent is not null"), F.col("parent"), F.col("id"), ("Section",), ("Section",)),
        EdgeTable(parts.filter("scenario is not null"), F.col("requirement"), F.col("scenario"), ("Requirement",), ("Scenario",)),
    ]
    places = parts.select(F.coalesce("scenario", "requirement").alias("target"), F.coalesce("scenario", "requirement").alias("place"))
    ends = ("Section", "Requirement", "Scenario")
    at = F.concat("path", F.lit("#"), F.coalesce(F.col("symbol"), F.lit("")))
    if code != "off":
        name = F.concat("path", F.lit("#"), F.when(F.col("parent").isNotNull(), F.concat("parent", F.lit("."), "name")).otherwise(F.col("name")))
        declared = symbols(files).withColumn("id", name).dropDuplicates(["id"])
        if code == "annotated":
            declared = declared.join(notes.select(at.alias("id")).distinct(), "id", "left_semi")
        sources = notes.filter("symbol is null").select(F.col("path")).distinct()
        g.node_tables["CodeSymbol"] = NodeTable(declared, F.col("id"))
        g.node_tables["CodeFile"] = NodeTable(sources, F.concat("path", F.lit("#")))
        places = places.unionByName(declared.select(F.col("id").alias("target"), F.col("id").alias("place"))).unionByName(sources.select(F.col("path").alias("target"), F.concat("path", F.lit("#")).alias("place")))
        ends += ("CodeSymbol", "CodeFile")
    places = places.dropDuplicates(["target"])

    def placed(links: DataFrame) -> DataFrame:
        """links (path, line, target, section) with ``to``, where that is another section, a requirement, a scenario or code."""
        met = section_targets(links, own).join(places, "target", "left").withColumn("to", F.coalesce("to", "place")).drop("place")
        return met.filter("section is not null and to is not null and section <> to")

    lines = parsed_edges(docs).select("path", "type", "sign", (F.col("line") + 1).alias("line"), F.concat_ws("#", "target", "subpath").alias("target"))
    typed = placed(in_sections(lines, own)).select("section", "type", "sign", "to", "line").persist()
    linked = placed(references(docs, own).drop("alias")).join(typed.select("section", "to"), ["section", "to"], "left_anti")
    named = document_keys(docs).select("path", F.explode("specs").alias("entry")).select("path", F.regexp_replace("entry", "^openspec:", "").alias("name")).join(spec_names(parts), "name")
    about = own.filter("depth = 1").join(named, "path").select(F.col("id").alias("section"), F.col("requirement").alias("to"), F.col("start").alias("line"))
    linked = linked.select("section", "to", "line").unionByName(about).groupBy("section", "to").agg(F.min("line").alias("line"))
    g.edge_tables["references"] = [EdgeTable(linked, F.col("section"), F.col("to"), ("Section",), ends, ("line",))]
    g.kept.append(typed)
    for row in typed.select("type").distinct().collect():  # as many rows as the documents use types
        table = EdgeTable(typed.filter(F.col("type") == row["type"]), F.col("section"), F.col("to"), ("Section",), ends, ("line",), F.col("sign"), single=False)
        g.edge_tables.setdefault(row["type"], []).append(table)
    if code == "off":
        return g
    annotated = notes.filter("kind = 'tg'")
    for kind in ("implements", "verifies"):
        table = EdgeTable(annotated.filter(F.col("type") == kind), at, F.col("target"), ("CodeSymbol", "CodeFile"), ("Requirement", "Scenario"), ("line", "test"), F.col("sign"), single=False, complete=False)
        g.edge_tables.setdefault(kind, []).append(table)
    to_doc = section_targets(notes.filter("kind = 'lat'"), own).filter("to is not null")
    g.edge_tables["references"].append(EdgeTable(to_doc, at, F.col("to"), ("CodeSymbol", "CodeFile"), ("Section",), ("line",), single=False))
    return g


def lattice_findings(docs: DataFrame, files: DataFrame) -> DataFrame:
    """code, path, line and target of links that lead nowhere, of code that isn't there, and of leaf sections that code should mention and doesn't.

    A missing name in a file that can't be read reliably is ``unresolvable``, since its absence proves nothing.
    """
    known, notes = sections(docs), annotation_rows(files)
    symbol = F.concat("path", F.lit("#"), F.when(F.col("parent").isNotNull(), F.concat("parent", F.lit("."), "name")).otherwise(F.col("name")))
    declared = symbols(files).select(symbol.alias("target")).distinct().withColumn("there", F.lit(True))
    reliable = by_text(files, "file string, reliable string", lambda p, t: [(p, str(scan(p, t)[1]).lower())])
    links = section_targets(references(docs).select("path", "line", "target"), known).filter("to is null")
    code = links.withColumn("file", F.substring_index("target", "#", 1)).join(reliable, "file", "left").join(declared, "target", "left")
    wrong = F.when(F.col("reliable").isNull(), "broken-link").when(F.contains("target", F.lit("#")) & F.col("there").isNull(), F.when(F.col("reliable") == "true", "missing-symbol").otherwise("unresolvable"))
    in_docs = code.select(wrong.alias("code"), "path", "line", "target").filter("code is not null")
    cited = section_targets(notes.filter("kind = 'lat'").select("path", "line", "target"), known)
    in_code = cited.filter("to is null").select(F.lit("broken-code-reference").alias("code"), "path", "line", "target")
    leaves = known.join(known.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    asked = leaves.join(document_keys(docs).filter("mention"), "path", "left_semi")
    unmentioned = asked.join(cited.filter("to is not null").select(F.col("to").alias("id")), "id", "left_anti").select(F.lit("not-mentioned").alias("code"), "path", F.col("start").alias("line"), F.col("id").alias("target"))
    return in_docs.unionByName(in_code).unionByName(unmentioned)


def spec_findings(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """code, path and target of the entries under ``openspec`` that are neither a capability nor a requirement nor a scenario."""
    entries = document_keys(docs).select("path", F.explode("specs").alias("target")).withColumn("name", F.regexp_replace("target", "^openspec:", ""))
    return entries.join(spec_names(requirements(specs)), "name", "left_anti").select(F.lit("unknown-specification").alias("code"), "path", "target")


#: A line of an index file that lists an entry.
ENTRY_PATTERN = r"(?m)^- \[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def index_findings(files: DataFrame, root: str) -> DataFrame:
    """code, path and target of what is wrong with index files. files: (path, text) of all that stands under ``root``, whatever its kind.

    A folder with notes in or below it has an index ``<folder>/<folder>.md``, which lists the notes and folders right in it as ``- [[name]]``. Codes:
    ``not-markdown``, ``missing-index``, ``not-listed`` (target: the note or folder) and ``lists-nothing`` (target: what is listed and isn't there).
    """
    under = files.filter(F.startswith("path", F.lit(root.rstrip("/") + "/")))
    is_note = F.endswith("path", F.lit(".md"))
    other = under.filter(~is_note).select(F.lit("not-markdown").alias("code"), "path", F.lit(None).cast("string").alias("target"))
    notes = under.filter(is_note).select("path", F.coalesce("text", F.lit("")).alias("text"))
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    parts = F.split("path", "/")
    depth = len(root.rstrip("/").split("/"))
    way = F.transform(F.sequence(F.lit(depth + 1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("folder"), F.element_at(parts, i).alias("child")))
    last = F.element_at(F.split("folder", "/"), -1)
    index = F.concat("folder", F.lit("/"), stem(last), F.lit(".md"))
    held = notes.select(F.inline(way)).distinct().withColumn("path", index).filter(F.concat_ws("/", "folder", "child") != F.col("path")).select("path", stem(F.col("child")).alias("target")).distinct()
    wanted = held.select("path").distinct()
    missing = wanted.join(notes, "path", "left_anti").select(F.lit("missing-index").alias("code"), "path", F.lit(None).cast("string").alias("target"))
    written = notes.join(wanted, "path", "left_semi")
    listed = written.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ENTRY_PATTERN), 1))).alias("target"))
    unlisted = held.join(written.select("path"), "path", "left_semi").join(listed, ["path", "target"], "left_anti").select(F.lit("not-listed").alias("code"), "path", "target")
    itself = stem(F.element_at(F.split("path", "/"), -1))
    nothing = listed.filter(F.col("target") != itself).join(held, ["path", "target"], "left_anti").select(F.lit("lists-nothing").alias("code"), "path", "target")
    return other.unionByName(missing).unionByName(unlisted).unionByName(nothing)
