"""Token ids of whole texts by the tokenizers library, with a cache of what lies between spaces.

The pre-tokenizers of the two vocabularies never form a token over a single space or newline that has other characters on both
sides (a byte-level token may begin with the space), so a text's ids are those of its pieces in order.  Texts with other white
space or with a special token go to the library whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

TAIL = ".,!?;:"


class Encoder:
    """``bytes_of(text)``: the ids, little-endian, in the smallest unsigned type that holds the vocabulary."""

    def __init__(self, path: str, most: int = 1_400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # The library reads these as one id wherever they stand, so texts that have any go to it whole.
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        n = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # the machine is little-endian, as the files are
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # A byte-level vocabulary without normalizer keeps white space.
        self.keeps_space = bool(self.tok.encode("a\nb", add_special_tokens=False).ids != self.tok.encode("a b", add_special_tokens=False).ids)
        self.newline = len(self.whole("\n")) if self.keeps_space else 0

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _ask(self, pieces: list[str]) -> None:
        """Looks new pieces up with the library; a piece stands after a space unless it begins a line."""
        lead = " " if self.keeps_space else ""
        texts = [p if p[0] == "\n" else lead + p for p in pieces]
        for p, e in zip(pieces, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.new[p] = array(self.code, e.ids).tobytes()

    def _bare(self, marks: str) -> bytes:
        """The ids of marks that directly follow a letter."""
        key = "\0" + marks
        if key not in self.new:
            self.new[key] = self.whole(marks)
        return self.new[key]

    def _learn(self, pieces: set[str]) -> None:
        """Puts new pieces in the cache, of which the older half goes when it is full.  Marks after a letter always are tokens of their own."""
        known, old = self.new, self.old
        ask: set[str] = set()
        split: list[tuple[str, str, str]] = []
        for p in pieces:
            if p in old:
                known[p] = old[p]
                continue
            core = p.rstrip(TAIL)
            if core != p and core and core[-1].isalpha():
                split.append((p, core, p[len(core) :]))
                if core in known:
                    continue
                if core in old:
                    known[core] = old[core]
                    continue
                p = core
            ask.add(p)
        if ask:
            self._ask(list(ask))
        for p, core, tail in split:
            known[p] = known[core] + self._bare(tail)

    def bytes_of(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self.whole(text)
        # A line's first piece keeps its newline; the text's own first piece borrows one.
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:] if self.keeps_space else text.replace("\n", " ").split(" ")
        different = set(pieces)
        if len(pieces) != len(text.split()) or "" in different or "\n" in different:
            return self.whole(text)
        if len(self.new) > self.most // 2:
            self.old, self.new = self.new, {}
        if missing := different.difference(self.new):
            self._learn(missing)
        return b"".join(map(self.new.__getitem__, pieces))[self.newline :]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary; workers live over many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
