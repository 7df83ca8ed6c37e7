import pytest

from quillgraph.sources import code as C


def names(path, text):
    return [(n, k, p) for n, k, p, *_ in C.scan(path, text)[0]]


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.ts", "export function f() { return '}' }\nclass A {\n  x = () => 1;\n  async go(a) {\n    if (a) {}\n  }\n}\nconst c = 1; // class Z {\ninterface I { a: string }\nenum E { A }\ntype T = 'x';\nvar v;\n", [("f", "function", None), ("A", "class", None), ("x", "method", "A"), ("go", "method", "A"), ("c", "const", None), ("I", "interface", None), ("E", "enum", None), ("T", "type", None), ("v", "variable", None)]),
        ("a.py", 'import os\nX: int = 1\ndef f():\n    """class No:"""\n    y = 2\nclass K:\n    z = 1\n    def m(self):\n        def n(): pass\n    async def q(self): pass\n', [("X", "variable", None), ("f", "function", None), ("K", "class", None), ("m", "method", "K"), ("q", "method", "K")]),
        ("a.go", "package p\nfunc F() {}\nfunc (t *T) M() {\n}\ntype T struct {\n  a int\n}\ntype I interface { X() }\nconst (\n  A = 1\n  B\n)\nvar V = 2\n", [("F", "function", None), ("M", "method", "T"), ("T", "struct", None), ("I", "interface", None), ("A", "const", None), ("B", "const", None), ("V", "const", None)]),
        ("a.rs", "pub fn f() {}\npub struct S { a: i32 }\nimpl S {\n  pub fn m(&self) {}\n}\ntrait T {\n  fn n(&self);\n}\nmod q;\n", [("f", "function", None), ("S", "struct", None), ("m", "method", "S"), ("T", "trait", None), ("n", "method", "T"), ("q", "module", None)]),
        ("a.c", "#define MAX 3\nstruct P {\n  int x;\n  char y[3];\n};\ntypedef int num;\nint add(int a, int b) {\n  return a + b;\n}\n", [("MAX", "macro", None), ("P", "struct", None), ("x", "field", "P"), ("y", "field", "P"), ("num", "type", None), ("add", "function", None)]),
        ("a.txt", "def f(): pass", []),
        ("a.py", "", []),
    ],
)
def test_declarations(path, text, want):
    assert names(path, text) == want


def test_reliable_and_lines():
    assert C.scan("a.ts", "function f() {\n  return 1\n}\n") == ([("f", "function", None, 1, 3, "function f() {")], True)
    assert not C.scan("a.ts", "function f() {\n")[1] and not C.scan("a.ts", "const a = 'x\nlet b")[1] and not C.scan("a.ts", "class A { go() {} }")[1]


def test_annotations():
    text = "// @lat: [[doc#A]]\n// @tg: implements:: [[r#One]], -verifies:: [[r#Two]]\n\nexport function f() {}\n\n\n\n// @tg: verifies:: [[r#Three]]\ntest('works', () => {})\n// @lat: [[far]]\n\n\n\n\nconst g = 1\n"
    assert [r[1:] for r in C.annotations("a.ts", text)] == [(1, "lat", "references", 1, "doc#A", "f", None), (2, "tg", "implements", 1, "r#One", "f", None), (2, "tg", "verifies", -1, "r#Two", "f", None), (8, "tg", "verifies", 1, "r#Three", None, "works"), (10, "lat", "references", 1, "far", None, None)]
    assert C.annotations("a.ts", "const a = 1") == []
