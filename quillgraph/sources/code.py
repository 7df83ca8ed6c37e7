"""Declarations and annotations in source files, as rows.

A file is blanked first: what stands in strings and comments becomes spaces, so offsets and lines stay. The rest is cut into tokens with
their line and nesting, and each language has a small reader of the tokens that begin a declaration: modifiers are passed over, a keyword says
the kind, a name follows. Read are declarations outside all braces and, for containers, those one level inside. ``reliable`` is
false where strings, comments or braces don't balance, or a body stands on its own declaration's line: there the absence of a name proves nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import marks
from .notes import parse_note
from .sections import by_text

ATTACH_LINES = 3


@dataclass(frozen=True)
class Token:
    text: str
    line: int
    column: int
    depth: int  # of braces and brackets around it

    @property
    def is_name(self) -> bool:
        return self.text[0].isalpha() or self.text[0] in "_$"


@dataclass(frozen=True)
class Found:
    name: str
    kind: str
    parent: str | None = None
    container: str | None = None  # the kind of members to look for inside
    listed: bool = True  # an implementation block has members but is no declaration


class Tokens:
    """A place in the tokens of a statement."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def __getitem__(self, ahead: int) -> str:
        i = self.at + ahead
        return self.tokens[i].text if i < len(self.tokens) else ""

    def skip(self, *words: str) -> Tokens:
        while self[0] in words:
            self.at += 1
        return self

    def take(self, *words: str) -> bool:
        here = self[0] in words
        self.at += here
        return here

    def name(self) -> str | None:
        i = self.at
        return self.tokens[i].text if i < len(self.tokens) and self.tokens[i].is_name else None

    def group(self, opens: str, closes: str) -> list[str]:
        """The tokens in the group that begins here, which is passed over; [] if none does."""
        if self[0] != opens:
            return []
        depth, start = 0, self.at + 1
        while self.at < len(self.tokens):
            depth += (self[0] == opens) - (self[0] == closes)
            self.at += 1
            if not depth:
                break
        return [t.text for t in self.tokens[start : self.at - 1]]

    def until(self, *words: str) -> list[str]:
        start = self.at
        while self.at < len(self.tokens) and self[0] not in words:
            self.at += 1
        return [t.text for t in self.tokens[start : self.at]]


def _named(t: Tokens, kind: str, parent: str | None = None, container: str | None = None) -> Found | None:
    name = t.name()
    return Found(name, kind, parent, container) if name else None


# The words of each language that matter here.
CONTROL = {"if", "for", "while", "switch", "catch", "return", "function", "new", "throw", "await", "else", "do", "typedef"}


def _script(t: Tokens) -> Found | None:
    t.skip("export", "default", "declare", "abstract", "async")
    if t.take("function"):
        return _named(t.skip("*"), "function")
    if t.take("class"):
        return _named(t, "class", container="class")
    if t[0] == "const" and t[1] == "enum":
        t.take("const")
    for kind in ("interface", "enum"):
        if t.take(kind):
            return _named(t, kind)
    if t[0] == "type" and t[2] in ("=", "<"):
        t.take("type")
        return _named(t, "type")
    if t.take("var"):
        return _named(t, "variable")
    return _named(t, "const") if t.take("const", "let") else None


def _script_member(t: Tokens) -> Found | None:
    words = ("public", "private", "protected", "static", "readonly", "override", "abstract", "async", "get", "set")
    while t[0] in words and t[1] not in ("(", "=", ":", "<", ";", ""):
        t.at += 1
    t.skip("*")
    name = t.name()
    if not name or name in CONTROL:
        return None
    t.at += 1
    t.take("?", "!")
    t.group("<", ">")
    if t[0] == "(":
        return Found(name, "method")
    if t.take(":"):
        t.until("=")
    if not t.take("="):
        return None
    t.take("async")
    if t[0] == "function":
        return Found(name, "method")
    if t[0] == "(":
        t.group("(", ")")
        t.until("=>", ";", "{")
    else:
        t.at += 1
    return Found(name, "method") if t[0] == "=>" else None


def _python(t: Tokens) -> Found | None:
    if t[0] == "async" and t[1] == "def":
        t.at += 1
    if t.take("def"):
        return _named(t, "function")
    if t.take("class"):
        return _named(t, "class", container="class")
    name = t.name()
    t.at += 1
    if t[0] == ":":
        t.until("=")
    return Found(name, "variable") if name and t[0] == "=" and name not in ("else", "try", "finally") else None


def _python_member(t: Tokens) -> Found | None:
    t.skip("async")
    return _named(t, "method") if t.take("def") else None


def _go(t: Tokens) -> Found | None:
    if t.take("func"):
        receiver = t.group("(", ")")
        if not receiver:
            return _named(t, "function")
        plain = receiver[: receiver.index("[")] if "[" in receiver else receiver
        return _named(t, "method", parent=next((w for w in reversed(plain) if w[0].isalpha() or w[0] == "_"), None))
    if t.take("type"):
        name = t.name()
        t.at += 1
        t.group("[", "]")
        return Found(name, t[0] if t[0] in ("struct", "interface") else "type") if name else None
    return _named(t, "const") if t.take("const", "var") else None


def _rust(t: Tokens) -> Found | None:
    if t.take("pub"):
        t.group("(", ")")
    ahead = 0
    while t[ahead] in ("default", "const", "async", "unsafe", "extern"):
        ahead += 1
    if t[ahead] == "fn":
        t.at += ahead + 1
        return _named(t, "function")
    if t[0] == "unsafe":
        t.at += 1
    if t.take("impl"):
        t.group("<", ">")
        path = t.until("{", "where")
        if "for" in path:
            path = path[path.index("for") + 1 :]
        path = path[: path.index("<")] if "<" in path else path
        names = [w for w in path if w[0].isalpha() or w[0] == "_"]
        return Found(names[-1], "impl", container="impl", listed=False) if names else None
    if t.take("trait"):
        return _named(t, "trait", container="impl")
    for words, kind in ((("struct", "union"), "struct"), (("enum",), "enum"), (("type",), "type"), (("mod",), "module")):
        if t.take(*words):
            return _named(t, kind)
    return _named(t.skip("mut"), "const") if t.take("static", "const") else None


def _rust_member(t: Tokens) -> Found | None:
    found = _rust(t)
    return Found(found.name, "method") if found and found.kind == "function" else None


def _c(t: Tokens) -> Found | None:
    if t.take("#"):
        return _named(t, "macro") if t.take("define") else None
    alias = t[0] == "typedef"
    ahead = int(alias)
    for words, kind in ((("enum",), "enum"), (("struct", "union"), "struct")):
        if t[ahead] in words and t[ahead + 2] in ("{", ""):
            t.at += ahead + 1
            return _named(t, kind, container=kind)
    if alias:
        words = t.until(";")
        while words and words[-1] == "]":
            words = words[: len(words) - 1 - words[::-1].index("[")]
        return Found(words[-1], "type") if words and (words[-1][0].isalpha() or words[-1][0] == "_") else None
    if t[0] in CONTROL:
        return None
    words = t.until("(", ";", "=", "{")
    if t[0] != "(" or len(words) < 2 or not (words[-1][0].isalpha() or words[-1][0] == "_"):
        return None
    t.group("(", ")")
    return Found(words[-1], "function") if t[0] in ("{", "") else None


def _c_field(t: Tokens) -> Found | None:
    words = t.until(";", ":", "[", "(")
    return Found(words[-1], "field") if t[0] and t[0] != "(" and len(words) > 1 and words[-1][0] not in "*}" else None


def _c_enumerator(t: Tokens) -> Found | None:
    return Found(t[0], "constant") if t.name() and t[1] in ("=", ",", "") else None


@dataclass(frozen=True)
class Language:
    line: str  # comment to the end of the line
    block: tuple[str, str] | None
    quotes: tuple[str, ...]
    declaration: Callable[[Tokens], Found | None]
    members: dict[str, Callable[[Tokens], Found | None]]
    indented: bool = False  # nesting is by indentation, not by braces
    groups: tuple[str, ...] = ()  # words that may open a bracket with a declaration a line


_SCRIPT = Language("//", ("/*", "*/"), ('"', "'", "`"), _script, {"class": _script_member})
LANGUAGES = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": Language("#", None, ('"""', "'''", '"', "'"), _python, {"class": _python_member}, indented=True),
    "go": Language("//", ("/*", "*/"), ('"', "`", "'"), _go, {}, groups=("const", "var", "type")),
    "rust": Language("//", ("/*", "*/"), ('"',), _rust, {"impl": _rust_member}),
    "c": Language("//", ("/*", "*/"), ('"', "'"), _c, {"struct": _c_field, "enum": _c_enumerator}),
}
_EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "c": "c", "h": "c"}


def language_of(path: str) -> str | None:
    name, dot, extension = path.rpartition("/")[2].rpartition(".")
    return _EXTENSIONS.get(extension) if dot and name else None


def blank(text: str, language: Language) -> tuple[str, bool]:
    """The text with strings and comments as spaces, and whether all of them end."""
    openers = sorted((*language.quotes, language.line, *(language.block or ())[:1]), key=len, reverse=True)
    out, at, whole = list(text), 0, True

    def line_end(i: int) -> int:
        end = text.find("\n", i)
        return len(text) if end < 0 else end

    while at < len(text):
        mark = next((o for o in openers if text.startswith(o, at)), None)
        if mark is None:
            at += 1
            continue
        start, at = at, at + len(mark)
        if mark == language.line:
            at = line_end(at)
        elif language.block and mark == language.block[0]:
            end = text.find(language.block[1], at)
            whole &= end >= 0
            at = end + len(language.block[1]) if end >= 0 else len(text)
        else:
            limit = len(text) if len(mark) == 3 or mark == "`" else line_end(at)
            while at < limit and not text.startswith(mark, at):
                at += 2 if text[at] == "\\" else 1
            closed = at < limit
            whole &= closed
            at = at + len(mark) if closed else limit
        out[start:at] = [c if c == "\n" else " " for c in text[start:at]]
    return "".join(out), whole


def tokens_of(masked: str) -> tuple[list[Token], bool]:
    """Names and numbers, ``=>``, ``::`` and single marks; and whether braces and brackets balance."""
    out: list[Token] = []
    depth, fine = 0, True
    for n, line in enumerate(masked.split("\n")):
        at = 0
        while at < len(line):
            c = line[at]
            if c.isspace():
                at += 1
                continue
            end = at + 1
            if c.isalnum() or c in "_$":
                while end < len(line) and (line[end].isalnum() or line[end] in "_$"):
                    end += 1
            elif line[at : at + 2] in ("=>", "::", "==", ":="):
                end = at + 2
            if c in "})":
                depth -= 1
                fine &= depth >= 0
            out.append(Token(line[at:end], n, at, depth))
            if c in "{(":
                depth += 1
            at = end
    return out, fine and not depth


def scan(path: str, text: str) -> tuple[list[tuple], bool]:
    """(name, kind, parent, first line, last line, signature) of a file's declarations, and whether absence is proof."""
    language = language_of(path)
    if not language:
        return [], False
    lang = LANGUAGES[language]
    masked, whole = blank(text, lang)
    tokens, balanced = tokens_of(masked)
    source = text.split("\n")
    firsts = [i for i, t in enumerate(tokens) if not i or tokens[i - 1].line < t.line]  # the first token of each line that has any
    reliable = whole and (balanced or lang.indented)
    out: list[tuple] = []

    def last_line(k: int) -> int:
        """The line on which the declaration ends that begins with the k-th line."""
        t = tokens[firsts[k]]
        if lang.indented:
            inside = [tokens[i].line for i in _while(firsts[k + 1 :], lambda i: tokens[i].column > t.column)]
            return inside[-1] if inside else t.line
        opened = None
        for i in range(firsts[k], len(tokens)):
            u = tokens[i]
            if u.text == "{" and u.depth == t.depth:
                opened = u.line
            elif u.depth == t.depth and (u.text == "}" or (u.text == ";" and opened is None)):
                return u.line
            elif opened is None and u.line > t.line and u.depth <= t.depth and i in starts and u.text not in ("{", ")", "=", ":", "where"):
                return t.line
        return tokens[-1].line if opened is not None else t.line

    starts = set(firsts)

    def statement(k: int) -> Tokens:
        """The tokens from a line's first on, to the end of the lines that its brackets hold together."""
        end = k + 1
        while end < len(firsts) and tokens[firsts[end]].depth > tokens[firsts[k]].depth and "{" not in [u.text for u in tokens[firsts[k] : firsts[end]]]:
            end += 1
        return Tokens(tokens[firsts[k] : firsts[end] if end < len(firsts) else len(tokens)])

    def add(f: Found, parent: str | None, k: int) -> int:
        t, end = tokens[firsts[k]], last_line(k)
        if f.listed:
            out.append((f.name, f.kind, f.parent or parent, t.line + 1, end + 1, source[t.line].strip()[:160]))
        return end

    k = 0
    while k < len(firsts):
        t = tokens[firsts[k]]
        k += 1
        if t.column and lang.indented or not lang.indented and t.depth:
            continue
        here = statement(k - 1)
        if here[0] in lang.groups and here[1] == "(":
            for j in range(k, len(firsts)):
                u = tokens[firsts[j]]
                if u.depth == t.depth + 1 and u.is_name:
                    add(Found(u.text, "type" if here[0] == "type" else "const"), None, j)
                elif u.depth <= t.depth:
                    break
            continue
        found = lang.declaration(here)
        if not found:
            continue
        end = add(found, None, k - 1)
        member = lang.members.get(found.container)
        if not member:
            continue
        inside = list(_while(range(k, len(firsts)), lambda j: tokens[firsts[j]].line <= end))
        if not lang.indented and end == t.line and _has_body(tokens, firsts[k - 1], t):
            reliable = False
        level = tokens[firsts[inside[0]]].column if inside and lang.indented else None
        for j in inside:
            u = tokens[firsts[j]]
            if (u.column == level) if lang.indented else (u.depth == t.depth + 1):
                if m := member(statement(j)):
                    add(m, found.name, j)
    return out, reliable


def _while(items, holds):
    for x in items:
        if not holds(x):
            return
        yield x


def _has_body(tokens: list[Token], start: int, first: Token) -> bool:
    """Whether something stands in the braces on a declaration's own line."""
    line = [t for t in tokens[start:] if t.line == first.line]
    return any(a.text == "{" and b.text != "}" for a, b in zip(line, line[1:], strict=False))


# What begins a comment line or a comment, and the calls that name a test.
COMMENTS = ("//", "#", "*", "/*", "*/", "--", "<!--")
TYPED_AFTER = ("/", "#", "-", "*", ";")
TESTS = ("it", "test", "describe")


def _references(line: str) -> list[str]:
    """Targets of ``@lat: [[...]]`` right after the start of a line comment."""
    out, at = [], line.find("@lat:")
    while at >= 0:
        before, start = line[:at].rstrip(), marks.skip_blank(line, at + 5)
        close = line.find("]]", start)
        if before.endswith(("//", "#")) and line.startswith("[[", start) and close > start + 2 and "]" not in line[start:close]:
            out.append(line[start + 2 : close])
        at = line.find("@lat:", at + 5)
    return out


def _payload(line: str) -> str | None:
    """What a ``@tg:`` comment says, without the comment's end."""
    before, mark, rest = line.partition("@tg:")
    if not mark or not before.rstrip().endswith(TYPED_AFTER):
        return None
    return rest.strip().removesuffix("*/").removesuffix("-->").strip()


def _split_edges(payload: str) -> list[str]:
    """Cuts ``a:: [[x]], -b:: [[y]]`` before every type."""
    out, start, comma = [], 0, payload.find(",")
    while comma >= 0:
        at = marks.skip_blank(payload, comma + 1)
        name = at + (payload[at : at + 1] in ("+", "-"))
        end = marks.name_end(payload, name)
        if end > name and payload.startswith("::", end):
            out.append(payload[start:comma])
            start = at
        comma = payload.find(",", comma + 1)
    return [*out, payload[start:]]


def _test_name(line: str) -> str | None:
    """The first argument of a call such as ``it.only('name', ...)``."""
    call, bracket, rest = line.strip().partition("(")
    if not bracket or call.split(".")[0] not in TESTS or rest[:1] not in ("'", '"', "`"):
        return None
    name, closed, _ = rest[1:].partition(rest[0])
    return name if closed else None


def annotations(path: str, text: str) -> list[tuple]:
    """(path, line, kind, type, sign, target, symbol, test) of ``@lat:`` and ``@tg:`` comments. Each belongs to the declaration that starts within
    ATTACH_LINES lines of the comment's end, or to a test call that stands there, or else to the file."""
    if "@lat:" not in text and "@tg:" not in text:
        return []
    lines, declared = text.split("\n"), None
    out: list[tuple] = []
    for i, line in enumerate(lines):
        if "@lat:" not in line and "@tg:" not in line:
            continue
        end = i + 1
        while end < len(lines) and lines[end].lstrip().startswith(COMMENTS):
            end += 1
        near = range(end, min(len(lines), end + ATTACH_LINES))
        declared = scan(path, text)[0] if declared is None else declared
        own = next((f"{p}.{n}" if p else n for n, _, p, first, *_ in declared if first - 1 in near), None)
        test = _test_name(next((lines[j] for j in near if lines[j].strip()), ""))
        out += [(path, i + 1, "lat", "references", 1, target, own, None) for target in _references(line)]
        for part in _split_edges(payload) if (payload := _payload(line)) else ():
            for kind, sign, target, place, *_ in parse_note(path, part)[0]:
                out.append((path, i + 1, "tg", kind, sign, f"{target}#{place}" if place else target, None if test else own, test))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Declarations of files (path, text)."""
    return by_text(files, "path string, name string, kind string, parent string, start int, end int, signature string, reliable string", lambda p, t: [(p, *s, str(ok).lower()) for found, ok in [scan(p, t)] for s in found])


def annotation_rows(files: DataFrame) -> DataFrame:
    return by_text(files, "path string, line int, kind string, type string, sign int, target string, symbol string, test string", annotations)
