"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions only where a keyword hit, then the checksum that the secret carries.

Kinds, in the order that breaks ties between spans with the same start:

* assign, access, hex: the base rules (no checksum; a length test drops short ones).
* github: ``gh[pousr]_`` and 36 base-62 characters, of which the last 6 are the CRC-32 of the 30 before them in base 62.
* npm: ``npm_`` and 36 characters with the same checksum.
* jwt: three base64url parts, of which the first decodes to a JSON object with an ``alg``.
* pem: a private key block from its BEGIN line to the next END line of the same label, without another BEGIN between them.

Offsets are code points, the end is exclusive. Null and empty texts have no spans; a null doc_id is kept.
The automaton finds ASCII keywords in a copy whose A-Z are lowered byte by byte, so offsets stay those of the text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Kinds in their order, the keywords of each kind that has some, and the base patterns.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin",),
}
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is found whole, so this is the base rule with its length test
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(?:[^-]|-(?!----(?:BEGIN |END \1-----)))*+-----END \1-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(6, "0")


def crc_holds(m: re.Match) -> bool:
    return base62_crc(m[1][:30]) == m[1][30:]


def jwt_holds(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):  # not JSON, or nested too deep to be a token's head
        return False
    return isinstance(head, dict) and "alg" in head


#: kind: (pattern tried where a keyword of the kind starts, test of a match)
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, crc_holds),
    "npm": (NPM, crc_holds),
    "jwt": (JWT, jwt_holds),
    "pem": (PEM, lambda m: True),
}


@cache
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w) - 1))
    out.make_automaton()
    return out


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then kind."""
    if not text:
        return []
    starts: dict[str, list[int]] = {}
    for end, (kind, back) in automaton().iter(lower_ascii(text)):
        starts.setdefault(kind, []).append(end - back)
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, found in starts.items():
        pattern, holds = RULES[kind]
        free = 0  # as finditer: a match that fails its test still takes its characters
        for at in sorted(found):
            if at < free:
                continue
            if m := pattern.match(text, at):
                free = m.end()
                if holds(m):
                    spans.append((at, free, kind))
            elif kind == "jwt":  # any later start in this run fails for the same reason, so time stays linear
                free = JWT_RUN.match(text, at).end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b, _ in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, last = [], 0
    for a, b in merged(spans):
        out += [text[last:a], mask]
        last = b
    return "".join([*out, text[last:]])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            spans = scan(text.as_py())
            base = [s for s in spans if s[2] in KINDS[:3]]
            rows.append((doc_id, *(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans and all spans as text. No shuffle."""
    return common.texts(docs).mapInArrow(_scan_batches, SCHEMA)


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start, end."""
    one = F.explode(F.split("spans", ",")).alias("span")
    parts = F.split("span", ":")
    return scan_secrets(docs).filter("n_spans > 0").select("doc_id", one).select("doc_id", parts[0].alias("kind"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of every text replaced by the mask; null texts stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text in batch.column(at):
                text = text.as_py()
                new.append(masked(text, spans, mask) if text and (spans := scan(text)) else text)
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(new, batch.schema.field(at).type))

    return common.small_arrow_batches(docs).mapInArrow(run, docs.schema)


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(common.documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


__all__ = ["mask_secrets", "scan", "scan_secrets", "secret_spans"]
