"""Token ids of whole texts, with a memory of the chunks already met.

Byte-level vocabularies cut a text before each single blank between two other characters, so the
chunks so made can be encoded apart.  A worker keeps the ids of chunks it has met.  A new chunk is
cut into the vocabulary's pieces, and the tokenizer's model encodes each new piece, which spares the
alignment of characters that ``encode`` keeps.  Chunks with characters whose class might depend on
the Unicode version, and texts in which a blank stands beside other white space, go through ``encode``,
and so do texts that contain the string of an added token, which ``encode`` gives the token's id.
"""

from __future__ import annotations

import contextlib
import os
import re
import struct

import numpy as np

VOCABULARY = "byte_bpe_50k.json"

#: Chunks, and half as many pieces, a worker remembers before it starts anew (some 220 bytes each).
REMEMBERED = 400_000
#: Bytes of text encoded at a time; the more, the fewer chunks are looked up.
SLICE = 1 << 23

#: The pieces that byte-level vocabularies of this kind are trained on.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that stand for themselves; the others, in order, stand from 256 on.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_ODD = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")
_SHOWN = {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(PLAIN))}


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size, self.model, self.cut = self.tokenizer.get_vocab_size(), self.tokenizer.model, regex.compile(PIECES).findall
        self.byte_level = "ByteLevel(add_prefix_space=False" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.remembered = remembered
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        shown = piece.replace(" ", "Ġ") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_SHOWN)
        ids = [t.id for t in self.model.tokenize(shown)]
        self.pieces[piece] = raw = struct.pack(f"<{len(ids)}I", *ids)
        return raw

    def learn(self, chunks) -> None:
        """Ids of chunks that follow a blank.  None marks those that can't be encoded apart."""
        later, known, piece = self.later, self.pieces, self.piece
        plain, tokenize, pack = [], self.model.tokenize, struct.pack
        for c in chunks:
            if self.byte_level and c.isalpha() and (c.isascii() or not _ODD.search(c)):  # a single piece
                ids = [t.id for t in tokenize("Ġ" + c if c.isascii() else f" {c}".encode().decode("latin-1").translate(_SHOWN))]
                later[c] = pack(f"<{len(ids)}I", *ids)
            elif not c or c[0].isspace() or c[-1].isspace():
                later[c] = None
            elif not self.byte_level or not c.isascii() and _ODD.search(c) or "\x1b" < c[0] < " ":
                later[c] = self.direct(" " + c)
            else:
                plain.append(c)
        joined = " " + " ".join(plain)
        if _ODD.search(joined):  # separators in the midst of a chunk
            for c in plain:
                if _ODD.search(c):
                    later[c] = self.direct(" " + c)
            plain = [c for c in plain if c not in later]
            joined = " " + " ".join(plain)
        if not plain:
            return
        part, names = [], iter(plain)
        for p in self.cut(joined):
            if p[0] == " " and part:
                later[next(names)] = b"".join(part)
                part = []
            part.append(known.get(p) or p[0] == " " and later.get(p[1:]) or piece(p))
        later[next(names)] = b"".join(part)

    def forget(self) -> None:
        for memory, most in ((self.later, self.remembered), (self.pieces, self.remembered // 2), (self.first, self.remembered // 4)):
            if len(memory) > most:
                memory.clear()

    def head(self, head: str) -> bytes:
        if head not in self.first:
            if len(head) > 100:
                return self.direct(head)
            self.first[head] = self.direct(head)
        return self.first[head]

    def encode_column(self, column, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, each text's followed by ``end``, and where each text's begin and end.

        Chunks are numbered by Arrow, so Python looks at each distinct chunk of the column once.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        self.forget()
        column = pc.fill_null(column, "")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if not len(column):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        lists = pc.split_pattern(column, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds, values = bounds - bounds[0], lists.flatten()
        coded = values.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        nth = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        later = self.later
        heads = [chunks[k] for k in nth[bounds[:-1]].tolist()]
        new = [c for c in chunks if c not in later]
        if new:
            self.learn(new)
        raw = [later[c] for c in chunks]
        bad = np.array([r is None for r in raw])
        if bad.any():
            follows = np.ones(len(nth), dtype=bool)
            follows[bounds[:-1]] = False
            wrong = set((np.searchsorted(bounds, np.flatnonzero(bad[nth] & follows), side="right") - 1).tolist())
            raw = [r or b"" for r in raw]
        else:
            wrong = set()
        for content in self.added:
            wrong |= set(np.flatnonzero(pc.match_substring(column, content).to_numpy(zero_copy_only=False)).tolist())
        wrong |= {d for d, h in enumerate(heads) if bounds[d + 1] - bounds[d] > 1 and (not h or h[-1].isspace())}
        nth[bounds[:-1]] = np.arange(len(raw), len(raw) + len(heads))
        raw += [self.direct(column[d].as_py()) if d in wrong else self.head(h) for d, h in enumerate(heads)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        for d in wrong:
            nth[bounds[d] + 1 : bounds[d + 1]] = len(raw)
        mark = b"" if end is None else struct.pack("<I", end)
        ids = np.frombuffer(b"".join(raw) + mark, "<u4")
        first = np.cumsum(sizes) - sizes
        # an empty entry for what a whole text's ids stand for, and the end id
        sizes, first = np.append(sizes, [0, len(mark) // 4]), np.append(first, [0, len(ids) - 1])
        order = np.insert(nth, bounds[1:], len(raw) + 1)
        size = sizes[order]
        after = np.cumsum(size)
        at = np.arange(after[-1]) + np.repeat(first[order] - (after - size), size)
        ends = after[bounds[1:] + np.arange(len(heads))]
        return ids[at], np.concatenate([[0], ends])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        import pyarrow as pa

        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


    def release(self) -> None:
        """Forgets all chunks: an idle worker holds no memory that the next task's kind may need."""
        self.later, self.pieces, self.first = {}, {}, {}


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder; the vocabulary stays as long as the Python worker does."""
    key = path or vocabulary()
    if key not in _encoders:
        _encoders[key] = Encoder(key)
    return _encoders[key]


@contextlib.contextmanager
def encoding(path: str | None = None):
    """The worker's encoder for a task, at whose end it forgets."""
    enc = encoder(path)
    try:
        yield enc
    finally:
        enc.release()
