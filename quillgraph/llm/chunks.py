"""Distinct-chunk tables: each distinct chunk of text is segmented once, and ids are joined back by position.

A text is cut only where no token can reach across: in front of white space that follows something else. The chunks of a
batch are dictionary-encoded without copying the text, chunks not yet in the table are handed to the tokenizer together (end to end
as one text where the same cuts stand between them), and one Arrow ``take`` lays the ids of all chunks end to end. Texts in which that cut isn't known to be safe (rare white space
beyond ASCII, or a literal U+2581 for pieces) are encoded whole.

The table is kept for a worker's later batches and tasks. Its size is bounded: beyond ``KEEP`` chunks, or for chunks over
``LONG`` bytes, a chunk is segmented once for each batch that has it. The result is the same either way.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEEP, LONG = 1_000_000, 64
#: Bytes of text that are cut at once, and those of gathered batches.
AT_ONCE, GATHERED = 4 << 20, 16 << 20

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACES = frozenset(np.flatnonzero(_ASCII_SPACE).tolist())
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[32] = True
# First bytes (of two or three) of white space beyond ASCII, and of the piece marker U+2581.
_WIDE_SPACE = {0xC2: (b"\xc2\x85", b"\xc2\xa0"), 0xE1: (b"\xe1\x9a\x80",), 0xE2: tuple(b"\xe2\x80" + bytes([x]) for x in [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]) + (b"\xe2\x81\x9f",), 0xE3: (b"\xe3\x80\x80",)}
_CONTROL_SPACE = (0x1C, 0x1D, 0x1E, 0x1F)
_MARK = {0xE2: (b"\xe2\x96\x81",)}


class ChunkTable:
    """encode: the ids (below 65536, little-endian uint16) of each of a list of chunks; whole: the ids of one text, for texts that aren't cut."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], whole: Callable[[str], list[int]], pieces: bool = False):
        self.encode, self.whole = encode, whole
        self.space, self.unsafe = (_ONLY_SPACE, _MARK) if pieces else (_ASCII_SPACE, _WIDE_SPACE)
        self.odd = np.zeros(256, bool)
        self.odd[[*self.unsafe, *(() if pieces else _CONTROL_SPACE)]] = True
        self.known: dict[bytes, bytes] = {}

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = self.encode([chunks[i] for i in missing])
            for i, x in zip(missing, new, strict=True):
                found[i] = x
                if len(self.known) < KEEP and len(chunks[i]) <= LONG:
                    self.known[chunks[i]] = x
        return found

    def _unsafe_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odd = np.flatnonzero(self.odd[data])  # one pass over the text finds all that may be unsafe
        hits = [odd[data[odd] <= 0x1F]]
        for first, seqs in self.unsafe.items():
            at = odd[data[odd] == first]
            if len(at):
                for s in seqs:
                    ok = np.ones(len(at), bool)
                    for k, c in enumerate(s[1:], 1):
                        ok &= data[np.minimum(at + k, len(data) - 1)] == c
                    hits.append(at[ok])
        at = np.concatenate(hits)
        rows = np.zeros(len(offsets) - 1, bool)
        if len(at):
            rows[np.searchsorted(offsets, at, side="right") - 1] = True
        return rows

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts and their offsets (from 0): the ids of all texts end to end, and each text's offset in them."""
        n = len(offsets) - 1
        whole = self._unsafe_rows(data, offsets)
        space = self.space[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        cut[starts] = True
        for r in np.flatnonzero(whole):
            cut[offsets[r] + 1 : offsets[r + 1]] = False
        at = np.flatnonzero(cut)
        first = np.searchsorted(at, offsets)  # of each text in the chunks
        if not len(at):
            return np.zeros(0, np.uint16), np.zeros(n + 1, np.int64)
        bounds = np.append(at, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        index = coded.indices
        if whole.any():
            ids: list[bytes | None] = [None] * len(distinct)
            alone = set(index.to_numpy()[first[:-1][whole]].tolist())
            rest = [i for i in range(len(distinct)) if i not in alone]
            for i, x in zip(rest, self._ids([distinct[i] for i in rest]), strict=True):
                ids[i] = x
            for i in alone:
                ids[i] = np.array(self.whole(distinct[i].decode("utf-8")), "<u2").tobytes()
        else:
            ids = self._ids(distinct)
        laid = pa.array(ids, pa.binary()).take(index)
        ends = np.frombuffer(laid.buffers()[1], np.int32)[laid.offset : laid.offset + len(laid) + 1]
        flat = np.frombuffer(laid.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u2")
        return flat, (ends[first] - ends[0]).astype(np.int64) // 2


def marked_words(table: ChunkTable, data: np.ndarray, offsets: np.ndarray, marker: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts over the texts with a leading space in each that isn't empty."""
    lengths = np.diff(offsets)
    has = (lengths > 0).astype(np.int64)
    new = np.concatenate(([0], np.cumsum(lengths + has)))
    out = np.empty(int(new[-1]), np.uint8)
    put = np.ones(len(out), bool)
    put[new[:-1][has > 0]] = False
    out[~put] = marker
    out[put] = data
    return table.encode_texts(out, new)


def pieces_of(batch: pa.RecordBatch, most: int = AT_ONCE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes of their texts and offsets from 0."""
    from .common import flat_bytes, small_batches

    for part in small_batches(batch, "text", most):
        data, offsets = flat_bytes(part.column("text"))
        yield part, np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, of at most about ``most`` bytes unless one is larger by itself: a chunk beyond the table is segmented once in each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _deal(group: list[int], ids: list[int], bounds: np.ndarray, out: list[bytes]) -> None:
    """Gives each chunk of a group its stretch of the group's ids."""
    raw, at = np.array(ids, "<u2").tobytes(), (2 * bounds).tolist()
    for i, a, b in zip(group, at[:-1], at[1:], strict=True):
        out[i] = raw[a:b]


_tables: dict[tuple[str, str], ChunkTable] = {}


def tokenizer_table(name: str, ordinary_specials: bool = True) -> ChunkTable:
    """Table of a tokenizers file by its name in public_tokenizers; with ordinary_specials the strings of special tokens are ordinary text."""
    from .common import hold

    hold(f"tokenizers {name}", _tables.clear)
    if ("tokenizers", name) not in _tables:
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.encode_special_tokens = ordinary_specials

        def encode(chunks: list[bytes], at_once: int = 512) -> list[bytes]:
            words = [c.decode("utf-8") for c in chunks]
            out: list[bytes] = [b""] * len(words)
            fits = [c[0] in _SPACES and c[-1] not in _SPACES for c in chunks]  # stand end to end as in a text, cut in front of each
            joined, apart = ([i for i, x in enumerate(fits) if x is which] for which in (True, False))
            for k in range(0, len(joined), at_once):
                group = joined[k : k + at_once]
                e = t.encode("".join(words[i] for i in group), add_special_tokens=False)
                begins = np.cumsum([0, *(len(words[i]) for i in group)])
                _deal(group, e.ids, np.searchsorted(np.fromiter((a for a, _ in e.offsets), np.int64, len(e)), begins), out)
            for k in range(0, len(apart), at_once):
                group = apart[k : k + at_once]
                e = t.encode([words[i] for i in group], is_pretokenized=True, add_special_tokens=False)
                _deal(group, e.ids, np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(group) + 1)), out)
            return out

        _tables["tokenizers", name] = ChunkTable(encode, lambda text: t.encode(text, add_special_tokens=False).ids)
    return _tables["tokenizers", name]


def piece_processor(name: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


def pieces_stay_in_words(sp) -> bool:
    """True if no piece has white space after something else, and text is neither normalised nor squeezed: then words can be segmented apart."""
    marks = "▁"
    inside = any(marks in p.lstrip(marks) for p in map(sp.id_to_piece, range(sp.vocab_size())))
    probe = "  a  b\tc ﬁ "
    return not inside and sp.decode(sp.encode(probe)) == probe


def piece_table(name: str) -> ChunkTable:
    from .common import hold

    hold(f"pieces {name}", _tables.clear)
    if ("pieces", name) not in _tables:
        sp = piece_processor(name)
        if not pieces_stay_in_words(sp):
            raise ValueError(f"{name}: pieces may cross white space, or text is changed before it is cut")
        mark = [sp.piece_to_id("▁")]

        def encode(chunks: list[bytes]) -> list[bytes]:
            # The library puts one marker in front of what it gets, unless that is empty; so a chunk goes in without its first space.
            return [np.array(x if len(c) > 1 else mark, "<u2").tobytes() for c, x in zip(chunks, sp.encode([c[1:].decode("utf-8") for c in chunks], num_threads=1), strict=True)]

        table = ChunkTable(encode, lambda text: sp.encode(text[1:]), pieces=True)
        table.sp = sp
        _tables["pieces", name] = table
    return _tables["pieces", name]
