from quillgraph.plans.compile import run
from quillgraph.sources import sections as S
from quillgraph.sources.lattice import index_findings, lattice_findings, lattice_graph, spec_findings


def test_lattice(spark):
    docs = spark.createDataFrame([("doc.md", "# A\nlead\n\nsee [[doc#A#B]] and [[C]]\n## B\nx\n"), ("other.md", "# C\ny [[none]]\n")], "path string, text string")
    specs = spark.createDataFrame([("specs/cap/spec.md", "### Requirement: One\n#### Scenario: s\n")], "path string, text string")
    files = spark.createDataFrame([("a.py", "# @tg: implements:: [[openspec:cap#One]]\ndef f():\n    pass\n\ndef g():\n    pass\n# @lat: [[C]]\nX = 1\n")], "path string, text string")
    g = lattice_graph(spark, docs, specs, files)
    q = lambda text: sorted(tuple(r) for r in run(g, text).df.collect())
    assert q("MATCH (a:Section)-[:references]->(b:Section) RETURN id(a) AS a, id(b) AS b") == [("doc.md#A", "doc.md#A#B"), ("doc.md#A", "other.md#C")]
    assert q("MATCH (a:Section)-[:contains]->(b) RETURN id(a) AS a, id(b) AS b") == [("doc.md#A", "doc.md#A#B")]
    assert q("MATCH (c:CodeSymbol)-[r:implements]->(x:Requirement) RETURN c.name AS c, id(x) AS x, r.sign AS s") == [("f", "openspec:cap#One", 1)]
    assert q("MATCH (c:CodeSymbol)-[:references]->(s) RETURN c.name AS c, id(s) AS s") == [("X", "other.md#C")]
    assert q("MATCH (c:CodeSymbol) RETURN count(*) AS n") == [(2,)] and run(lattice_graph(spark, docs, specs, files, "all"), "MATCH (c:CodeSymbol) RETURN count(*) AS n").df.first()["n"] == 3


def test_findings(spark):
    schema = "path string, text string"
    docs = spark.createDataFrame([("d.md", "---\nrequire-code-mention: true\n---\n# A\n[[nowhere]] [[d#A]] [[s.py#f]]\n# B\n[[s.py#g]] [[s.py]] [[bad.ts#x]]\n")], schema)
    files = spark.createDataFrame([("s.py", "# @lat: [[d#A]]\ndef f(): pass\n# @lat: [[gone]]\n"), ("bad.ts", "const a = 'x\n")], schema)
    assert {(r["code"], r["line"], r["target"]) for r in lattice_findings(docs, files).collect()} == {("broken-link", 5, "nowhere"), ("missing-symbol", 7, "s.py#g"), ("unresolvable", 7, "bad.ts#x"), ("broken-code-reference", 3, "gone"), ("not-mentioned", 6, "d.md#B")}


TEXTS = "path string, text string"


def test_typed_edges_of_sections(spark):
    docs = spark.createDataFrame([("d.md", "---\nopenspec: [cap, other#Two]\nsee: [[d]]\n---\n# A\nlead\n\n-blocks:: [[openspec:cap#One]], [[nowhere]], [[d#A]]\n\nlike [[openspec:cap#One]], [[d#A]] and [[a.py#f]]\n## B\nneeds:: [[d#A]]\n"), ("e.md", None)], TEXTS)
    specs = spark.createDataFrame([("specs/cap/spec.md", "### Requirement: One\n"), ("specs/other/spec.md", "### Requirement: Two\n### Requirement: Three\n")], TEXTS)
    files = spark.createDataFrame([("a.py", "# @tg: implements:: [[openspec:cap#One]]\ndef f():\n    pass\n")], TEXTS)
    g = lattice_graph(spark, docs, specs, files)
    rows = {tuple(r) for r in run(g, "MATCH (s:Section)-[r]->(x) RETURN type(r) AS t, id(s) AS s, id(x) AS x, r.sign AS sign, r.line AS line").df.collect()}
    assert rows == {
        ("contains", "d.md#A", "d.md#A#B", 1, None),
        ("blocks", "d.md#A", "openspec:cap#One", -1, 8),
        ("needs", "d.md#A#B", "d.md#A", 1, 12),
        ("references", "d.md#A", "openspec:cap#One", 1, 5),
        ("references", "d.md#A", "openspec:other#Two", 1, 5),
        ("references", "d.md#A", "a.py#f", 1, 10),
    }
    off = lattice_graph(spark, docs, specs, files, "off")
    assert run(off, "MATCH (s:Section)-[r:references]->(x) RETURN count(*) AS n").df.first()["n"] == 2
    none = lattice_graph(spark, docs.limit(0), specs, files)
    assert run(none, "MATCH (s:Section)-[r:references]->(x) RETURN count(*) AS n").df.first()["n"] == 0


def test_documents_of_requirements(spark):
    parts = S.requirements(spark.createDataFrame([("specs/cap/spec.md", "### Requirement: One\n#### Scenario: s\n### Requirement: Two\n"), ("specs/x/spec.md", "### Requirement: One\n")], TEXTS))
    docs = spark.createDataFrame([("a.md", "---\nopenspec: cap\n---\n"), ("b.md", "---\nopenspec:\n  - cap#One#s\n  - openspec:cap#One\n  - gone\n---\n"), ("c.md", ""), ("n.md", None)], TEXTS)
    rows = S.trace(parts, spark.createDataFrame([], "type string, sign int, target string"), S.document_keys(docs)).collect()
    assert {(r["requirement"], r["documents"], r["documented"]) for r in rows} == {("openspec:cap#One", 2, True), ("openspec:cap#Two", 1, True), ("openspec:x#One", 0, False)}
    specs = spark.createDataFrame([("specs/cap/spec.md", "### Requirement: One\n#### Scenario: s\n")], TEXTS)
    assert [tuple(r) for r in spec_findings(docs, specs).collect()] == [("unknown-specification", "b.md", "gone")]


def test_index_files(spark):
    texts = {"docs/docs.md": "- [[a]]\n- [[sub|x]]\n- [[docs]]\n- [[old]] gone\n * [[no]]\n", "docs/a.md": "", "docs/b.md": None, "docs/sub/deep/x.md": "", "docs/pic.png": None, "docs/sub/sub.md": "- [[deep]]\n", "elsewhere/y.md": "", "docs/alone/alone.md": ""}
    rows = index_findings(spark.createDataFrame(list(texts.items()), TEXTS), "docs").collect()
    assert sorted((r["code"], r["path"], r["target"] or "") for r in rows) == [
        ("lists-nothing", "docs/docs.md", "old"),
        ("missing-index", "docs/sub/deep/deep.md", ""),
        ("not-listed", "docs/docs.md", "alone"),
        ("not-listed", "docs/docs.md", "b"),
        ("not-markdown", "docs/pic.png", ""),
    ]
    assert index_findings(spark.createDataFrame([], TEXTS), "docs").count() == 0


def test_documents_of_people_are_read_by_all_cores(spark):
    from quillgraph.plans import vault_queries

    assert vault_queries.people(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_references_take_known_sections(spark):
    docs = spark.createDataFrame([("a.md", "# A\n[[x]]\n## B\n[[y#z|w]]\n"), ("b.md", "[[a]]\n# C\n[[C]]\n")], "path string, text string")
    known = S.sections(docs)
    assert sorted(map(tuple, S.references(docs, known).collect()), key=str) == sorted(map(tuple, S.references(docs).collect()), key=str)
