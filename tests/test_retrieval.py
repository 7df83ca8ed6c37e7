import os
from pyspark.sql import functions as F

from quillgraph.operators import retrieval as R
from quillgraph.sources import files, notes


def test_locate_tiers(spark):
    rows = [("docs/api.md#Server", "Server"), ("docs/api.md#Server#Routes", "Routes"), ("docs/cli.md#Commands", "Commands"), ("docs/cli.md#Routes", "Routes")]
    df = spark.createDataFrame(rows, "id string, heading string")

    def found(name):
        return [(r["id"], r["tier"]) for r in R.locate(df, name).collect()]

    assert found("DOCS/api.md#Server") == [("docs/api.md#Server", 0)]
    assert found("cli#Commands") == [("docs/cli.md#Commands", 1)]
    assert found("routes") == [("docs/api.md#Server#Routes", 2), ("docs/cli.md#Routes", 2)]
    assert found("docs#Routes") == [("docs/api.md#Server#Routes", 3), ("docs/cli.md#Routes", 3)]
    assert found("Comands") == [("docs/cli.md#Commands", 4)]
    assert found("nothing like it at all") == []


def test_vectors_are_embedded_once(spark):
    texts = spark.createDataFrame([(1, "red apple"), (2, "red apple"), (3, "blue sky"), (4, None)], "id int, text string")
    seen = []

    def embed(wanted):
        seen.append(wanted.count())
        return R.embed_hashed(wanted, 16)

    first, cache = R.vectors_for(texts, None, embed)
    again, _ = R.vectors_for(texts.unionByName(spark.createDataFrame([(5, "green leaf")], texts.schema)), cache, embed)
    assert seen == [3, 1] and again.count() == 5
    v = {r["id"]: r["vector"] for r in first.collect()}
    assert v[1] == v[2] != v[3] and set(v[4]) == {0.0} and len(v[1]) == 16


def test_hybrid_without_vectors_says_so(spark):
    docs = spark.createDataFrame([(1, "Apples", "red apple"), (2, "Sky", "blue")], "id int, title string, body string")
    hits, notices = R.hybrid(docs, "apple", {"title": "title", "body": "body"})
    assert [r["id"] for r in hits.collect()] == [1] and notices


def test_nodes_and_edges_by_vector(spark):
    nodes = spark.createDataFrame([("a", ["P"], "A"), ("b", ["Q"], "B")], "id string, labels array<string>, title string")
    chunks = spark.createDataFrame([("a", "h", "far", [0.1, 1.0]), ("a", "h2", "near", [1.0, 0.0]), ("b", "h", "x", [1.0, 0.1])], "id string, heading string, text string, vector array<double>")
    top = R.search_nodes(nodes, chunks, [1.0, 0.0]).collect()
    assert [(r["id"], r["citation"]["text"]) for r in top] == [("a", "near"), ("b", "x")]
    assert [r["id"] for r in R.search_nodes(nodes, chunks, [1.0, 0.0], "Q").collect()] == ["b"]
    edges = spark.createDataFrame([("e", "a knows b", [1.0, 0.0]), ("f", "b knows a", [-1.0, 0.0])], "id string, text string, vector array<double>")
    assert [(r["id"], r["text"]) for r in R.search_edges(edges, [1.0, 0.0]).collect()] == [("e", "a knows b")]


def test_context_of_a_chunk(spark):
    row = spark.createDataFrame([("T", ["A", "B"], "x" * 100, None)], "t string, l array<string>, k string, n int").select(R.chunk_context(F.col("t"), F.col("l"), {"k": F.col("k"), "n": F.col("n")}).alias("c")).first()
    assert row["c"] == "T (A, B)\nk: " + "x" * 80


def test_files_of_a_folder(spark, tmp_path):
    for name, text in (("a.md", "A"), ("sub/b.md", "B"), (".hidden/c.md", "C"), ("node_modules/d.md", "D"), ("e.adoc", "E"), ("f.txt", "F"), ("big.md", "x" * 100)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["path"] for r in files.read_files(spark, str(tmp_path), most=50).collect()} == {"a.md", "sub/b.md"}
    assert {r["path"] for r in files.read_notes(spark, str(tmp_path), asciidoc=True).collect()} == {"a.md", "sub/b.md", "e.adoc", "big.md"}


def test_duplicate_ids_are_reported(spark):
    vault = [("a.md", "x:: [[b]] {id: one}\ny:: [[b]] {id: one}\nz:: [[e]]\n"), ("b.md", ""), ("e.md", "---\ntype: edge\nfrom: a\nto: '[[b]]'\nedgeType: likes\nsign: -1\nwhy: so\n---\n")]
    g = notes.notes_graph(spark, spark.createDataFrame(vault, "path string, text string"))
    assert {(r["id"], r["type"], r["source"], r["target"], r["sign"]) for r in g.edges(None, {}).collect()} == {("one", "x", "a.md", "b.md", 1), ("e.md", "likes", "a.md", "b.md", -1)}
    assert [(r["path"], r["line"], r["id"]) for r in g.duplicate_ids().collect()] == [("a.md", 2, "one")]
    assert [(r["line"], r["target"]) for r in g.refused_links().collect()] == [(3, "e.md")]
    assert {r["id"] for r in g.nodes(None, {}).collect()} == {"a.md", "b.md"}
    g.close()


def test_files_of_any_bytes_and_relative_folders(spark, tmp_path):
    (tmp_path / "v" / "v").mkdir(parents=True)
    (tmp_path / "v" / "bad.md").write_bytes(b"x:: [[caf\xe9]]\n\xff\xfe\n")
    (tmp_path / "v" / "v" / "in.md").write_text("y:: [[bad]]\n")
    near = os.path.relpath(tmp_path / "v")
    for folder in (near, f"./{near}/", str(tmp_path / "v"), f"file://{tmp_path}/v"):
        got = {r["path"]: r["text"] for r in files.read_files(spark, folder).collect()}
        assert got == {"bad.md": "x:: [[caf\ufffd]]\n\ufffd\ufffd\n", "v/in.md": "y:: [[bad]]\n"}, folder
    assert [(r["path"], r["target"]) for r in notes.parsed_edges(files.read_notes(spark, near)).orderBy("path").collect()] == [("bad.md", "caf\ufffd"), ("v/in.md", "bad")]
