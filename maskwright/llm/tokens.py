"""Token ids by a public byte-level BPE file; the file is a parameter and is never trained here."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Id that ends every document.
END = 0
#: Distinct pieces that one generation of a worker's memo holds; two generations are kept.
MEMO = 500_000
_INNER = re.compile(r"(?<=\S)(?= \S)")
_ODD = [chr(c) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


#: Letters with their space, marks, and the same again after a line feed: each group is one run to the
#: file's splitting rule.  Only letters of these blocks, so that no digit or mark is taken for one.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_RUNS = re.compile(rf"( ?{_LETTERS})([.,;:!?$%&#*|]*)(?:(\n)({_LETTERS})([.,;:!?$%&#*|]*))?")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> list[str]:
    """The printable letter by which a byte-level vocabulary writes each byte: itself, or the next one above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """Encodes whole texts; equal pieces between single spaces are encoded once.

    The file's splitting rule always cuts before a single space that has other
    characters on both sides, so a text's ids are the ids of its pieces, joined.
    Everything else (runs of white space, odd spaces) stays inside one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _ODD):
            return _INNER.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        need = set().union(*cut).difference(self.new) if cut else set()
        odd = []
        for p in need:
            got = self.old.get(p)
            if got is None:
                m = _RUNS.fullmatch(p)
                if m is None:
                    odd.append(p)
                    continue
                got = b"".join([self.run(r) for r in m.groups() if r])
            self.new[p] = got
        for p, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.new[p] = packed(e.ids)
        return [b"".join(map(self.new.__getitem__, c)) for c in cut]

    def run(self, part: str) -> bytes:
        """Ids of a run that is never split before merging."""
        got = self.new.get(part) or self.old.get(part)
        if got is None:
            got = packed([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, part.encode())))])
            self.new[part] = got
        return got


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; workers are reused, so it loads once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(texts: list[str | None], path: str, limit: int = 1 << 20):
    """Ids of each text with the end id, in steps of about ``limit`` characters."""
    end = np.array([END], "<u4").tobytes()
    coder, held, size = encoder(path), [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= limit:
            yield from (x + end for x in coder.encode(held))
            held, size = [], 0
    yield from (x + end for x in coder.encode(held))
