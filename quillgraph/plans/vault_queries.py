"""Queries over notes, sections, requirement files and source files that are written from the star tables, and SQL over those tables that gives the
same rows: a region is a note and a section file, a nation a note, a section, a requirement and a source file, a customer a note."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embeds, retrieval, rules, validate, verbalize
from ..sources import code, notes, sections
from ..sources.lattice import index_findings, lattice_graph
from ..sources.store import released
from . import compile as C


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of notes. Customers avoid one of seven notes that don't exist."""
    c = F.col
    regions = _read(spark, sf_dir, "region").select(_text("regions/R", c("r_regionkey"), ".md").alias("path"), _text("---\ntype: Region\nname: ", c("r_name"), "\n---\n").alias("text"))
    nations = _read(spark, sf_dir, "nation").select(_text("nations/N", c("n_nationkey"), ".md").alias("path"), _text("---\ntype: Nation\nrank: ", c("n_nationkey"), "\n---\n# ", c("n_name"), "\n> - in_region:: [[R", c("n_regionkey"), "|home]] {since: ", c("n_nationkey") + 1900, ", tags: [a, 'b']}\n").alias("text"))
    customers = _read(spark, sf_dir, "customer").select(_text("customers/C", c("c_custkey"), ".md").alias("path"), _text("---\ntype: Customer\ntypes: [", c("c_mktsegment"), "]\n---\n## Home\nlives_in:: [[nations/N", c("c_nationkey"), "]]\n```\nlives_in:: [[R0]]\n```\n-avoids:: [[Nowhere ", F.pmod("c_custkey", F.lit(7)), "]] {level: ", F.pmod("c_custkey", F.lit(3)), "}\n").alias("text"))
    return regions.unionByName(nations).unionByName(customers).repartition(spark.sparkContext.defaultParallelism)


def edge_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each nation and one that stands for its edge to its region, with a link to that note from the nation."""
    c = F.col
    nation = _read(spark, sf_dir, "nation")
    ends = nation.select(_text("N", c("n_nationkey"), ".md").alias("path"), _text("---\ntype: Nation\n---\nsee:: [[E", c("n_nationkey"), "]]\n").alias("text"))
    edges = nation.select(_text("E", c("n_nationkey"), ".md").alias("path"), _text("---\ntype: edge\nfrom: \"[[N", c("n_nationkey"), "]]\"\nto: \"[[Region ", c("n_regionkey"), "]]\"\nedgeType: in_region\nweight: ", c("n_nationkey"), "\n---\n").alias("text"))
    return ends.unionByName(edges)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each region: a section with a lead and a part for each of its nations."""
    c = F.col
    part = _text("\n## ", c("n_name"), "\n\nThe nation ", c("n_name"), " refers to [[doc/", c("r_regionkey"), ".md#", c("r_name"), "]] here.\n")
    rows = _read(spark, sf_dir, "region").join(_read(spark, sf_dir, "nation"), c("r_regionkey") == c("n_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", part.alias("part")))), lambda x: x["part"]), "").alias("parts"))
    return rows.select(_text("doc/", c("r_regionkey"), ".md").alias("path"), _text("# ", c("r_name"), "\n\nLead of ", c("r_name"), ".\n", c("parts")).alias("text"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement file for each nation, with a scenario; for every third nation with a second one."""
    c = F.col
    second = F.when(F.pmod("n_nationkey", F.lit(3)) == 0, F.lit("#### Scenario: far\n")).otherwise(F.lit(""))
    return _read(spark, sf_dir, "nation").select(_text("specs/n", c("n_nationkey"), "/spec.md").alias("path"), _text("## Requirements\n### Requirement: ", c("n_name"), "\ntext\n#### Scenario: near\n", second).alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each nation: a class with a method, and a function that says what it implements and verifies."""
    c = F.col
    to = [_text("[[openspec:n", c("n_nationkey"), "#", c("n_name"), x, "]]") for x in ("", "#near")]
    return _read(spark, sf_dir, "nation").select(
        _text("src/n", c("n_nationkey"), ".py").alias("path"),
        _text("class Nation:\n    def name(self):\n        return 'def no():'\n\n\n# @tg: implements:: ", to[0], ", verifies:: ", to[1], "\n# @lat: [[doc/", c("n_regionkey"), ".md]]\ndef f_", c("n_nationkey"), "():\n    return 1\n").alias("text"),
    )


def _graph(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    g = notes.notes_graph(spark, vault(spark, sf_dir))
    return released(C.run(g, query).df, g.close)


def _lattice(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return C.run(lattice_graph(spark, documents(spark, sf_dir), specs(spark, sf_dir), files(spark, sf_dir)), query).df


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer about its nation's requirement, with a typed edge to a scenario and a link to code. Every other one names the capability."""
    c = F.col
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    key = F.when(c("c_custkey") % 2 == 0, _text("---\nopenspec:\n  - n", c("n_nationkey"), "\n---\n")).otherwise(F.lit(""))
    scenario = _text("[[openspec:n", c("n_nationkey"), "#", c("n_name"), "#near]]")
    return rows.select(_text("people/C", c("c_custkey"), ".md").alias("path"), _text(key, "# C", c("c_custkey"), "\n\nlead\n\nsuits:: ", scenario, "\n\nAs ", scenario, " says, see [[src/n", c("n_nationkey"), ".py#f_", c("n_nationkey"), "]] twice: [[src/n", c("n_nationkey"), ".py#f_", c("n_nationkey"), "]]\n").alias("text")).repartition(spark.sparkContext.defaultParallelism)


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each customer with two notes; some have an index, which may list too little or too much, and some a file that is no note."""
    c = F.col
    at = _text("lat/C", c("c_custkey"), "/")
    by = lambda n: c("c_custkey") % n == 0
    index = _text("# Index\n\n- [[a]] - first\n", F.when(by(3), F.lit("")).otherwise(F.lit("- [[b|second]] - second\n")), F.when(by(4), F.lit("- [[gone]]\n")).otherwise(F.lit("")))
    some = lambda when, name, text: F.when(when, F.struct(F.concat(at, name).alias("path"), text.alias("text")))
    rows = F.array(some(F.lit(True), F.lit("a.md"), F.lit("# A\n")), some(F.lit(True), F.lit("b.md"), F.lit("# B\n")), some(~by(5), _text("C", c("c_custkey"), ".md"), index), some(by(7), F.lit("x.txt"), F.lit("x")))
    return _read(spark, sf_dir, "customer").select(F.inline(F.filter(rows, lambda x: x.isNotNull())))


def lattice_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lattice_graph(spark, people(spark, sf_dir), specs(spark, sf_dir), files(spark, sf_dir))
    return released(C.run(g, "MATCH (s:Section)-[r:suits|references]->(x) RETURN type(r) AS type, id(x) AS x, count(*) AS n, min(r.line) AS line").df, g.close)


def lattice_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_findings(folders(spark, sf_dir), "lat").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.count_distinct("target").alias("targets"))


def requirement_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = code.annotation_rows(files(spark, sf_dir)).select("type", "sign", "target")
    return sections.trace(sections.requirements(specs(spark, sf_dir)), edges, sections.document_keys(people(spark, sf_dir))).select("requirement", "documented", "documents")


def note_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.parsed_edges(vault(spark, sf_dir))
    return rows.groupBy("type", "sign", "heading").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"), F.max("line").alias("line"), F.count("alias").alias("aliases")).withColumn("heading", F.when(F.col("type") == "in_region", "name").otherwise(F.col("heading"))).groupBy("type", "sign", "heading").agg(F.sum("n").alias("n"), F.max("targets").alias("targets"), F.max("line").alias("line"), F.sum("aliases").alias("aliases"))


def note_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.note_rows(vault(spark, sf_dir)).select("title", F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first"))


def note_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.note_rows(vault(spark, sf_dir))
    return rows.select(F.substring_index("path", "/", 1).alias("folder"), F.substring("hash", 1, 1).alias("h")).groupBy("folder", "h").agg(F.count(F.lit(1)).alias("n"))


def note_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vault(spark, sf_dir)
    found = notes.resolve_links(notes.parsed_edges(v).select("path", "target"), v.select("path"))
    return found.groupBy("to").agg(F.count(F.lit(1)).alias("n"))


def note_edge_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = notes.notes_graph(spark, edge_notes(spark, sf_dir))
    return released(C.run(g, "MATCH (a)-[r]->(b) RETURN id(r) AS id, type(r) AS type, a.title AS source, id(b) AS target, r.weight AS weight").df, g.close)


def note_refused_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = notes.notes_graph(spark, edge_notes(spark, sf_dir))
    return released(g.refused_links(), g.close)


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(documents(spark, sf_dir)).select("id", "parent", "depth", "lead")


def section_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.references(documents(spark, sf_dir)).select("target", "section")


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.chunks(documents(spark, sf_dir)).select("path", F.array_join("headings", "/").alias("headings"), "ordinal", "body")


def section_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.locate(sections.sections(documents(spark, sf_dir)), "doc#2.md", 100).unionByName(retrieval.locate(sections.sections(documents(spark, sf_dir)), "doc#NATION_8")).select("id", "tier")


def requirement_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.trace(sections.requirements(specs(spark, sf_dir)), code.annotation_rows(files(spark, sf_dir)).select("type", "sign", "target"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(files(spark, sf_dir)).select("path", "name", "kind", "parent", "start", "end", "reliable")


def code_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.annotation_rows(files(spark, sf_dir)).select("path", "line", "kind", "type", "target", "symbol")


def edge_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeds of every nation's edge to its region, and of one that doesn't exist, resolved."""
    v = vault(spark, sf_dir)
    g = notes.notes_graph(spark, v)
    c = F.col
    pages = _read(spark, sf_dir, "nation").select(_text("nations/N", c("n_nationkey"), ".md").alias("path"), _text("{{edge: [[N", c("n_nationkey"), "]] -in_region-> R", c("n_regionkey"), " . since}}\n{{edge: N", c("n_nationkey"), " -in_region-> R99}}\n").alias("text"))
    return released(embeds.resolve_embeds(embeds.embeds(pages), g.edges(None, {"line": g.edge_props()["line"]}), v.select("path")), g.close)


def edge_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = notes.notes_graph(spark, vault(spark, sf_dir))
    nodes = g.nodes(None, {"title": "string"})
    edges = g.edges(["in_region"], {"since": "double"}).withColumn("since", F.col("since").cast("long"))
    return released(verbalize.sentences(nodes.select("id", "title", "labels"), edges, ["since"]).select("id", "text"), g.close)


def vault_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = notes.notes_graph(spark, vault(spark, sf_dir))
    declared = [validate.EdgeRule("Nation", "in_region", properties=(validate.PropertyRule("", "until", required=True),)), validate.EdgeRule("Customer", "lives_in", targets=("Region",), sources=("Nation",)), validate.EdgeRule("Customer", "avoids", properties=(validate.PropertyRule("", "level", values=(0.0, 1.0)),))]
    found = validate.validate(g.nodes(None, {}), g.edges(None, {"level": "double"}), [], declared)
    return released(found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")), g.close)


def schema_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type for each market segment and for regions, and one edge type that every region declares, so that all but the first are duplicates."""
    c = F.col
    segments = _read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    types = segments.select(_text("Types/", c("c_mktsegment"), ".md").alias("path"), _text("---\nschema:\n  uri: seg:", c("c_mktsegment"), "\n  properties:\n    motto: {required: true}\n    types: {many: true}\n  edges:\n    lives_in: {target: Nation, required: true}\n    avoids:\n      many: false\n---\n").alias("text"))
    regions = _read(spark, sf_dir, "region")
    shared = regions.select(_text("Types/of", c("r_regionkey"), ".md").alias("path"), _text("---\nedgeTypes:\n  avoids:\n    from: [Customer]\n    properties:\n      level: {values: [0, 1]}\n  in_region: {to: Nation, properties: {until: {required: true}}}\nprefixes: {r", c("r_regionkey"), ": 'https://r/'}\n---\n").alias("text"))
    named = regions.filter("r_regionkey > 0").agg(F.array_join(F.array_sort(F.collect_list("r_name")), ", ").alias("names"))
    region = named.select(_text("Types/Region.md").alias("path"), _text("---\nschema: {properties: {name: {values: [", c("names"), "]}}}\n---\n").alias("text"))
    return types.unionByName(shared).unionByName(region)


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the declared rules find in the vault, and in the declarations themselves."""
    declared = rules.merge(rules.declarations(schema_notes(spark, sf_dir)))
    g = notes.notes_graph(spark, vault(spark, sf_dir))
    found = rules.check_notes(g, declared).unionByName(declared.findings.select(F.lit("declaration").alias("severity"), "code", "node", "detail"))
    return released(found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")), g.close)


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by words and by hashed vectors; the query is the name of a nation."""
    found = sections.sections(documents(spark, sf_dir))
    docs = retrieval.search_documents(found, sections.chunks(documents(spark, sf_dir)).select(F.concat_ws("#", "path", F.array_join("headings", "#")).alias("id"), "body"))
    vectors, _ = retrieval.vectors_for(docs.select("id", F.concat_ws(" ", "title", "summary").alias("text")))
    query = vectors.filter(F.endswith("id", F.lit("#NATION_7"))).first()["vector"]
    hits, _ = retrieval.hybrid(docs, "NATION_7", {"title": "title", "summary": "summary", "body": "body"}, vectors, query, limit=1)
    return hits.select("id")


def search_then_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations named by a search, and the customers that live there."""
    g = notes.notes_graph(spark, vault(spark, sf_dir))
    found = g.nodes(["Nation"], {}).select("id", "labels", F.col("id").alias("title"))
    chunks = found.select("id", F.lit(None).cast("string").alias("heading"), F.col("id").alias("text"), F.array(F.length("id").cast("double"), F.lit(1.0)).alias("vector"))
    hits = retrieval.search_nodes(found, chunks, [1.0, 0.0], "Nation", 100)
    return released(retrieval.then(g, hits, "MATCH (c:Customer)-[:lives_in]->(n) WHERE id(n) IN $hits RETURN id(n) AS id, count(c) AS n").df, g.close)


_NATION = "'nations/N' || n_nationkey || '.md'"
_DOC = "'doc/' || r_regionkey || '.md#' || r_name"
_JOINED = "region JOIN nation ON r_regionkey = n_regionkey"

ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "note_edge_lines": (note_edge_lines, """SELECT 'in_region' AS type, 1 AS sign, 'name' AS heading, count(*) AS n, 1 AS targets, 5 AS line, count(*) AS aliases FROM nation
        UNION ALL SELECT 'lives_in', 1, 'Home', count(*), count(DISTINCT c_nationkey), 5, 0 FROM customer UNION ALL SELECT 'avoids', -1, 'Home', count(*), count(DISTINCT c_custkey % 7), 9, 0 FROM customer"""),
    "note_labels": (note_labels, """SELECT 'Region' AS label, count(*) AS n, min('R' || r_regionkey) AS first FROM region UNION ALL SELECT 'Nation', count(*), min('N' || n_nationkey) FROM nation
        UNION ALL SELECT 'Customer', count(*), min('C' || c_custkey) FROM customer UNION ALL SELECT c_mktsegment, count(*), min('C' || c_custkey) FROM customer GROUP BY 1"""),
    "note_hashes": (note_hashes, """WITH t AS (SELECT 'regions' AS folder, '---' || chr(10) || 'type: Region' || chr(10) || 'name: ' || r_name || chr(10) || '---' || chr(10) AS text FROM region
        UNION ALL SELECT 'nations', '---' || chr(10) || 'type: Nation' || chr(10) || 'rank: ' || n_nationkey || chr(10) || '---' || chr(10) || '# ' || n_name || chr(10) || '> - in_region:: [[R' || n_regionkey || '|home]] {since: ' || (n_nationkey + 1900) || ', tags: [a, ''b'']}' || chr(10) FROM nation
        UNION ALL SELECT 'customers', '---' || chr(10) || 'type: Customer' || chr(10) || 'types: [' || c_mktsegment || ']' || chr(10) || '---' || chr(10) || '## Home' || chr(10) || 'lives_in:: [[nations/N' || c_nationkey || ']]' || chr(10) || '```' || chr(10) || 'lives_in:: [[R0]]' || chr(10) || '```' || chr(10) || '-avoids:: [[Nowhere ' || (c_custkey % 7) || ']] {level: ' || (c_custkey % 3) || '}' || chr(10) FROM customer)
        SELECT folder, left(sha256(text), 1) AS h, count(*) AS n FROM t GROUP BY 1, 2"""),
    "note_resolution": (note_resolution, f"SELECT 'regions/R' || n_regionkey || '.md' AS \"to\", count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT {_NATION}, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM customer"),
    "note_query": (lambda spark, sf_dir: _graph(spark, sf_dir, "MATCH (c:Customer)-[:lives_in]->(n:Nation)-[r:in_region]->(g) RETURN g.name AS region, count(c) AS n, max(r.since) AS latest"), "SELECT r_name AS region, count(*) AS n, CAST(max(n_nationkey) + 1900 AS DOUBLE) AS latest FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "note_stubs": (lambda spark, sf_dir: _graph(spark, sf_dir, "MATCH (c:Customer)-[r:avoids]->(n) WHERE n.stub RETURN id(n) AS id, count(*) AS n, min(r.sign) AS sign"), "SELECT 'Nowhere ' || (c_custkey % 7) AS id, count(*) AS n, -1 AS sign FROM customer GROUP BY 1"),
    "note_edge_ids": (lambda spark, sf_dir: _graph(spark, sf_dir, "MATCH ()-[r:lives_in]->() RETURN id(r) AS id"), "SELECT 'customers/C' || c_custkey || '.md#lives_in#nations/N' || c_nationkey || '.md#0' AS id FROM customer"),
    "note_edge_notes": (note_edge_notes, "SELECT 'E' || n_nationkey || '.md' AS id, 'in_region' AS type, 'N' || n_nationkey AS source, 'Region ' || n_regionkey AS target, CAST(n_nationkey AS DOUBLE) AS weight FROM nation"),
    "note_refused_links": (note_refused_links, "SELECT 'link-to-edge-note' AS code, 'N' || n_nationkey || '.md' AS path, 4 AS line, 'E' || n_nationkey || '.md' AS target FROM nation"),
    "section_tree": (section_tree, f"SELECT {_DOC} AS id, NULL AS parent, 1 AS depth, 'Lead of ' || r_name || '.' AS lead FROM region UNION ALL SELECT {_DOC} || '#' || n_name, {_DOC}, 2, 'The nation ' || n_name || ' refers to [[' || {_DOC} || ']] here.' FROM {_JOINED}"),
    "section_references": (section_references, f"SELECT {_DOC} AS target, {_DOC} || '#' || n_name AS section FROM {_JOINED}"),
    "section_chunks": (section_chunks, f"SELECT 'doc/' || r_regionkey || '.md' AS path, r_name AS headings, 0 AS ordinal, 'Lead of ' || r_name || '.' AS body FROM region UNION ALL SELECT 'doc/' || r_regionkey || '.md', r_name || '/' || n_name, 0, 'The nation ' || n_name || ' refers to [[' || {_DOC} || ']] here.' FROM {_JOINED}"),
    "section_locate": (section_locate, f"SELECT {_DOC} AS id, 3 AS tier FROM region WHERE r_regionkey = 2 UNION ALL SELECT {_DOC} || '#' || n_name, 3 FROM {_JOINED} WHERE r_regionkey = 2 UNION ALL SELECT {_DOC} || '#' || n_name, 3 FROM {_JOINED} WHERE n_name = 'NATION_8'"),
    "requirement_trace": (requirement_trace, "SELECT 'openspec:n' || n_nationkey || '#' || n_name AS requirement, TRUE AS implemented, n_nationkey % 3 <> 0 AS verified, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS scenarios FROM nation"),
    "code_symbols": (code_symbols, "SELECT 'src/n' || n_nationkey || '.py' AS path, u.name, u.kind, u.parent, u.first AS start, u.last AS \"end\", 'true' AS reliable FROM nation, LATERAL (SELECT 'Nation' AS name, 'class' AS kind, NULL AS parent, 1 AS first, 3 AS last UNION ALL SELECT 'name', 'method', 'Nation', 2, 3 UNION ALL SELECT 'f_' || n_nationkey, 'function', NULL, 8, 9) u"),
    "code_annotations": (code_annotations, "SELECT 'src/n' || n_nationkey || '.py' AS path, u.line, u.kind, u.type, u.target, 'f_' || n_nationkey AS symbol FROM nation, LATERAL (SELECT 6 AS line, 'tg' AS kind, 'implements' AS type, 'openspec:n' || n_nationkey || '#' || n_name AS target UNION ALL SELECT 6, 'tg', 'verifies', 'openspec:n' || n_nationkey || '#' || n_name || '#near' UNION ALL SELECT 7, 'lat', 'references', 'doc/' || n_regionkey || '.md') u"),
    "lattice_verified": (lambda spark, sf_dir: _lattice(spark, sf_dir, "MATCH (f:CodeSymbol)-[r:verifies]->(s:Scenario) RETURN id(f) AS f, id(s) AS s, r.line AS line"), "SELECT 'src/n' || n_nationkey || '.py#f_' || n_nationkey AS f, 'openspec:n' || n_nationkey || '#' || n_name || '#near' AS s, 6 AS line FROM nation"),
    "lattice_sections": (lambda spark, sf_dir: _lattice(spark, sf_dir, "MATCH (a:Section)-[:contains]->(b:Section)-[:references]->(a) RETURN id(a) AS a, count(b) AS n"), f"SELECT {_DOC} AS a, count(*) AS n FROM {_JOINED} GROUP BY 1"),
    "lattice_typed": (lattice_typed, """SELECT 'suits' AS type, 'openspec:n' || n_nationkey || '#' || n_name || '#near' AS x, count(*) AS n, min(CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE 5 END) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name
        UNION ALL SELECT 'references', 'src/n' || n_nationkey || '.py#f_' || n_nationkey, count(*), min(CASE WHEN c_custkey % 2 = 0 THEN 11 ELSE 7 END) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey
        UNION ALL SELECT 'references', 'openspec:n' || n_nationkey || '#' || n_name, count(*), 5 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 GROUP BY n_nationkey, n_name"""),
    "lattice_index": (lattice_index, """SELECT 'not-markdown' AS code, count(*) AS n, min('lat/C' || c_custkey || '/x.txt') AS first, 0 AS targets FROM customer WHERE c_custkey % 7 = 0
        UNION ALL SELECT 'missing-index', count(*) + 1, min('lat/C' || c_custkey || '/C' || c_custkey || '.md'), 0 FROM customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT 'not-listed', count(*), min('lat/C' || c_custkey || '/C' || c_custkey || '.md'), 1 FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0
        UNION ALL SELECT 'lists-nothing', count(*), min('lat/C' || c_custkey || '/C' || c_custkey || '.md'), 1 FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 = 0"""),
    "requirement_documents": (requirement_documents, "SELECT 'openspec:n' || n_nationkey || '#' || n_name AS requirement, count(c_custkey) > 0 AS documented, count(c_custkey) AS documents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 2 = 0 GROUP BY n_nationkey, n_name"),
    "edge_embeds": (edge_embeds, f"SELECT {_NATION} AS path, 0 AS line, {_NATION} || '#in_region#regions/R' || n_regionkey || '.md#0' AS edge, 1 AS matches FROM nation UNION ALL SELECT {_NATION}, 1, NULL, 0 FROM nation"),
    "edge_sentences": (edge_sentences, f"SELECT {_NATION} || '#in_region#regions/R' || n_regionkey || '.md#0' AS id, 'N' || n_nationkey || ' (Nation) in region R' || n_regionkey || ' (Region) - since ' || (n_nationkey + 1900) AS text FROM nation"),
    "vault_findings": (vault_findings, """SELECT 'error' AS severity, 'missing-edge-property' AS code, count(*) AS n, min('nations/N' || n_nationkey || '.md') AS first FROM nation
        UNION ALL SELECT 'error', 'edge-value-not-allowed', count(*), min('customers/C' || c_custkey || '.md') FROM customer WHERE c_custkey % 3 = 2
        UNION ALL SELECT 'warning', u.code, count(DISTINCT c_custkey), min('customers/C' || c_custkey || '.md') FROM customer, (VALUES ('wrong-target-type'), ('wrong-source-type')) u(code) GROUP BY u.code"""),
    "rule_findings": (rule_findings, """SELECT 'error' AS severity, 'missing-property' AS code, count(*) AS n, min('customers/C' || c_custkey || '.md') AS first FROM customer
        UNION ALL SELECT 'error', 'value-not-allowed', count(*), min('regions/R' || r_regionkey || '.md') FROM region WHERE r_regionkey = 0
        UNION ALL SELECT 'error', 'missing-edge-property', count(*), min('nations/N' || n_nationkey || '.md') FROM nation
        UNION ALL SELECT 'error', 'edge-value-not-allowed', count(*), min('customers/C' || c_custkey || '.md') FROM customer WHERE c_custkey % 3 = 2
        UNION ALL SELECT 'warning', 'wrong-target-type', count(*), min('nations/N' || n_nationkey || '.md') FROM nation
        UNION ALL SELECT 'declaration', 'duplicate-declaration', 2 * (count(*) - 1), 'Types/of1.md' FROM region
        UNION ALL SELECT 'declaration', 'unknown-prefix', count(DISTINCT c_mktsegment), min('Types/' || c_mktsegment || '.md') FROM customer"""),
    "search_hybrid": (search_hybrid, f"SELECT {_DOC} || '#' || n_name AS id FROM {_JOINED} WHERE n_name = 'NATION_7'"),
    "search_then_query": (search_then_query, f"SELECT {_NATION} AS id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ALL.items() if s}
