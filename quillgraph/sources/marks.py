"""Small readers of the marks that notes, sections, embeds and source comments share. Each looks at one place of one line."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def skip_blank(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def name_end(text: str, at: int) -> int:
    """Where the name that starts here ends: a letter or underscore, then letters, digits, underscores and hyphens. ``at`` if there is none."""
    if at >= len(text) or not (text[at].isalpha() or text[at] == "_"):
        return at
    while at < len(text) and (text[at].isalnum() or text[at] in "_-"):
        at += 1
    return at


def fence(line: str) -> str | None:
    """The mark of a line that opens or closes a fenced block."""
    start = line.lstrip()[:3]
    return start if start in ("```", "~~~") else None


def outside_fences(lines: Iterable[str]) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that are in no fenced block and are no fence."""
    opened = None
    for n, line in enumerate(lines):
        if mark := fence(line):
            if opened is None:
                opened = mark
            elif mark == opened:
                opened = None
        elif opened is None:
            yield n, line


def heading(line: str) -> tuple[int, str] | None:
    """(depth, text) of a line of one to six hashes, white space and a text; hashes at its end don't count."""
    text = line.lstrip("#")
    depth = len(line) - len(text)
    if not 1 <= depth <= 6 or not text[:1].isspace():
        return None
    return depth, text.strip().rstrip("#").rstrip()


def wiki_link(text: str, at: int) -> tuple[str, str | None, str | None, int] | None:
    """(target, anchor, alias, end) of ``[[target#anchor|alias]]`` here."""
    if not text.startswith("[[", at):
        return None
    close = text.find("]", at + 2)
    if close < 0 or not text.startswith("]]", close):
        return None
    place, bar, alias = text[at + 2 : close].partition("|")
    target, mark, anchor = place.partition("#")
    return target.strip(), (anchor.strip() or None) if mark else None, (alias.strip() or None) if bar else None, close + 2


def _quoted(text: str, at: int) -> int:
    """Where the quoted title here ends; ``at`` if there is none."""
    if at < len(text) and text[at] in "\"'":
        close = text.find(text[at], at + 1)
        return close + 1 if close > 0 else at
    return at


def markdown_link(text: str, at: int) -> tuple[str, str, int] | None:
    """(label, destination, end) of ``[label](destination "title")`` here; brackets in the label are balanced."""
    if not text.startswith("[", at):
        return None
    depth, close = 0, at
    while close < len(text):
        depth += {"[": 1, "]": -1}.get(text[close], 0)
        if not depth:
            break
        close += 1
    if depth or not text.startswith("(", close + 1):
        return None
    start = skip_blank(text, close + 2)
    end = start
    if text.startswith("<", start):
        end = text.find(">", start) + 1
        if not end:
            return None
    else:
        while end < len(text) and not text[end].isspace() and text[end] != ")":
            end += 1
    after = skip_blank(text, end)
    if after > end:
        after = skip_blank(text, _quoted(text, after))
    return (text[at + 1 : close], text[start:end], after + 1) if text.startswith(")", after) else None


def blank_code(line: str) -> str:
    """The line with its code spans as spaces: a run of backticks up to the next run of as many."""
    runs: list[tuple[int, int]] = []
    at = 0
    while at < len(line):
        end = at
        while end < len(line) and line[end] == "`":
            end += 1
        if end > at:
            runs.append((at, end))
        at = max(end, at + 1)
    out, k = list(line), 0
    while k < len(runs):
        a, b = runs[k]
        same = next((j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] == b - a), None)
        if same is None:
            k += 1
            continue
        out[a : runs[same][1]] = " " * (runs[same][1] - a)
        k = same + 1
    return "".join(out)


def _list_mark(line: str, at: int) -> int:
    """Where a bullet or a number with a point or bracket ends; ``at`` if there is none."""
    if at < len(line) and line[at] in "-*+":
        return at + 1
    end = at
    while end < len(line) and line[end].isdecimal():
        end += 1
    return end + 1 if end > at and line[end : end + 1] in (".", ")") else at


def edge_head(line: str) -> tuple[str, str, int] | None:
    """(sign, type, start of the value) of ``+type:: value``, which list and quote marks may precede."""
    at = skip_blank(line, 0)
    while at < len(line):
        if line[at] == ">":
            at = skip_blank(line, at + 1)
            continue
        end = _list_mark(line, at)
        if end == at or skip_blank(line, end) == end:
            break
        at = skip_blank(line, end)
    sign = line[at : at + 1] if line[at : at + 1] in ("+", "-") else ""
    start = at + len(sign)
    end = name_end(line, start)
    if end == start or not line.startswith("::", end):
        return None
    return sign, line[start:end], skip_blank(line, end + 2)
