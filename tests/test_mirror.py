import hashlib
import os
import random

from pyspark.sql import functions as F

from quillgraph.sources.notes import parsed_edges
from quillgraph.streaming import mirror as M

COLUMNS = ["path", "type", "target", "props", "line", "target_id", "stub"]
NOTE = "path string, text string"


def rows(df, columns=COLUMNS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def rebuilt(notes):
    return M.resolved(parsed_edges(notes), notes)


def files(folder):
    out = {}
    for d, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                out[os.path.relpath(f"{d}/{n}", folder)] = hashlib.sha256(open(f"{d}/{n}", "rb").read()).hexdigest()
    return out


def test_edits_end_as_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    names = ["n0.md", "a/n1.md", "b/n1.md", "n2.md", "a/n3.adoc", "n3.md", "c/n4.md"]

    def text():
        links = ["n0", "n1", "a/n1", "N2", "n3", "n3.md", "n4", "lost"]
        return "".join(f"t{rng.randrange(3)}:: [[{rng.choice(links)}]] {{k: {rng.randrange(9)}}}\n" for _ in range(rng.randrange(4)))

    notes = {n: text() for n in names[:5]}
    frame = lambda d: spark.createDataFrame(list(d.items()), NOTE)
    mirror = M.Mirror(spark, str(tmp_path / "mirror"), parts=5)
    seen = []

    def embed(wanted):
        seen.append(wanted.count())
        return M.embed_hashed(wanted, 4)

    mirror.sync(frame(notes), embed)
    before = rebuilt(frame(notes))
    for _ in range(4):
        for _ in range(2):
            path = rng.choice(names)
            if rng.random() < 0.4 and len(notes) > 2:
                notes.pop(path, None)
            else:
                notes[path] = text()
        now = frame(notes)
        mirror.sync(now, embed)
        after = rebuilt(now)
        assert rows(mirror.read("graph")) == rows(after)
        assert sorted(r["hash"] for r in mirror.read("vectors").collect()) == sorted({hashlib.sha256(t.encode()).hexdigest() for t in notes.values()})
        edge = ["path", "place", "type", "target_id"]
        told = mirror.changes()
        wide = ["path", "place", "type", "sign", "props", "target_id", "stub"]
        for says, a, b in (("insert", after, before), ("delete", before, after)):
            assert rows(told.filter((F.col("kind") == "edge") & (F.col("change") == says)), edge) == rows(a.select(*wide).exceptAll(b.select(*wide)), edge)
            gone = {r["target_id"] for r in a.filter("stub").collect()} - {r["target_id"] for r in b.filter("stub").collect()}
            assert {r["target_id"] for r in told.filter((F.col("kind") == "stub") & (F.col("change") == says)).collect()} == gone
        before = after
    assert seen[0] <= 5 and all(n <= 2 for n in seen[1:])


def test_one_change_writes_one_part(spark, tmp_path):
    notes = {f"n{i}.md": f"x:: [[n{(i + 1) % 20}]]\n" for i in range(20)}
    frame = lambda d: spark.createDataFrame(list(d.items()), NOTE)
    folder = str(tmp_path / "m")
    mirror = M.Mirror(spark, folder, parts=8)
    mirror.sync(frame(notes))
    first = files(folder)
    old = mirror.manifest()["tables"]
    mirror.sync(frame(notes | {"n3.md": "y:: [[n5]]\n"}))
    new, second = mirror.manifest()["tables"], files(folder)
    for name in ("notes", "edges", "graph"):
        assert sum(old[name]["at"].get(p) != g for p, g in new[name]["at"].items()) == 1, name
    assert sum(old["vectors"]["at"].get(p) != g for p, g in new["vectors"]["at"].items()) <= 2  # the new text's part, the old one's
    assert {k: v for k, v in second.items() if k in first} == first  # what was there is as it was
    mirror.sync(frame(notes | {"n3.md": "y:: [[n5]]\n"}))  # nothing changed
    assert mirror.manifest()["tables"]["graph"]["at"] == new["graph"]["at"] and mirror.changes().count() == 0
    mirror.sync(frame({k: v for k, v in notes.items() if k == "n7.md"}))
    assert mirror.read("graph").count() == 1 and mirror.read("graph", 1).count() == 20
    mirror.sync(frame({"n7.md": ""}))
    assert mirror.read("graph").count() == 0
    assert not set(files(folder)) & set(first) - {f for f in files(folder) if any(g in f for b in (0, 1) for t in mirror.manifest(b)["tables"].values() for g in t["at"].values())}


def test_notes_without_edges_are_not_parsed_again(spark, tmp_path, monkeypatch):
    seen = []
    parse = M.parsed_edges
    monkeypatch.setattr(M, "parsed_edges", lambda notes: (seen.append(notes.count()), parse(notes))[1])
    mirror = M.Mirror(spark, str(tmp_path / "m"), parts=4)
    notes = spark.createDataFrame([("a.md", ""), ("b.md", None), ("c.md", "x:: [[a]]\n")], NOTE)
    mirror.sync(notes)
    mirror.sync(notes)
    assert seen == [3, 0]


def test_another_model_makes_vectors_anew(spark, tmp_path):
    mirror, seen = M.Mirror(spark, str(tmp_path / "m"), parts=4), []

    def embed(wanted):
        seen.append(wanted.count())
        return M.embed_hashed(wanted, 4)

    notes = spark.createDataFrame([("a.md", "one"), ("b.md", "two"), ("c.md", "two")], NOTE)
    for model in ("m1", "m1", "m2"):
        mirror.sync(notes, embed, model)
    assert [n for n in seen if n] == [2, 2] and mirror.read("vectors").count() == 2


def test_a_broken_write_is_not_read(spark, tmp_path):
    mirror = M.Mirror(spark, str(tmp_path / "x"))
    assert mirror.read("t") is None and mirror.state() == (None, False)
    good = mirror.write({"t": spark.range(3)})
    broken = mirror.begin()
    mirror.put(broken, "t", spark.range(9), None, None, {"tables": {}})
    assert mirror.state() == (good, True) and mirror.read("t").count() == 3
    again = mirror.write({"t": spark.range(4)})
    assert mirror.state() == (again, False) and mirror.read("t").count() == 4 and mirror.read("t", 1).count() == 3
    assert broken not in mirror.at.names()


def test_changes_of_notes(spark):
    notes = spark.createDataFrame([("a.md", "x:: [[b]]\n"), ("b.md", "")], NOTE)
    renamed = M.rename(notes, "b.md", "c.md")
    assert [(r["target_id"], r["stub"]) for r in rebuilt(renamed).collect()] == [("b", True)]
    back = M.upsert(renamed, spark.createDataFrame([("b.md", "new")], notes.schema))
    assert [(r["target_id"], r["stub"]) for r in rebuilt(back).collect()] == [("b.md", False)]
    assert M.remove(back, back.filter("path = 'a.md'").select("path")).filter(F.col("path") == "a.md").count() == 0
