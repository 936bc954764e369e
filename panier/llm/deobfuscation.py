"""Noisy-channel restoration of disguised words.

A disguised span (leetspeak, spaced-out letters, repeated letters) is a lattice: each character was written for one of a few letters, or
for none, and marks between letters stand for nothing or for the end of a word.  Viterbi decoding finds the likeliest letters under a
character trigram model of all documents and the channel's costs.  Plain words have one path only and are left alone.

Spans have any length: the work is linear in it, and readings that all paths share are put away as they are found.  Letters that have no
class of their own share one, OTHER, and are kept as they are.  Edge cases: an empty text and one without spans come back in lower case;
a span of fewer than two letters is a number and stays.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

# Which letters a character may stand for (Latin, and Cyrillic where the neighbours are), and what each reading costs
# (natural log).
READS = {"0": "oо", "1": "il", "2": "z", "3": "eз", "4": "aч", "5": "s", "6": "gб", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
COST_READ, COST_SKIP_SIGN, COST_SKIP_MARK = 0.2, 4.0, 0.3
COST_SKIP_REPEAT, COST_SKIP_DOUBLE, COST_KEEP_REPEAT = 0.3, 2.5, 2.0
COST_BREAK, COST_JOIN_WIDE = 2.5, 3.0  # a mark that ends a word; one wider than others of its span that does not
ONE = r"(?:[^\W\d_]|[0-9@$!|+(])"
SPACED = rf"(?<![\w@$!|+(]){ONE}(?:[ .\-_*]{{1,3}}{ONE}){{3,}}(?![\w@$|+])"
MIXED = r"(?<![\w@$!|+(*])(?=[\w@$!|+(.*\-]*?[^\W\d_])(?=[\w@$!|+(.*\-]*?[0-9@$!|+(*_.\-])[^\W_0-9]*[0-9@$!|+(*._\-]+[\w@$!|+(.*\-]*[\w@$*]"
LONG = r"(?<![^\W\d_])[^\W\d_]*?(?P<twice>[^\W\d_])(?P=twice){2}[^\W\d_]*"
SPAN = re.compile(f"(?P<spaced>{SPACED})|{MIXED}|{LONG}")
SIGN, POINT, SINGLE = re.compile(r"[0-9@$!|+(*_\-]"), re.compile(r"\.[^\W\d_]"), re.compile(SPACED)
PARTS = re.compile(r"(?P<mark>[^\w@$!|+(]+|_+)|(?P<one>.)(?P=one)*", re.DOTALL)
LETTER = re.compile(r"[^\W\d_]")
BASE, SIZE = 64, 64**3
#: Code points with a class of their own in the model; all other letters are OTHER, all that is no letter a boundary.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýß"
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = BASE - 1
FLUSH = 2048  # parts after which what all paths share is put away
SHORT, REMEMBERED = 64, 50_000  # spans up to this length are remembered, and how many
PIECE = 1 << 20  # characters counted at a time


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    out = np.fromiter((OTHER if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint8, 0x110000)
    for c, i in CLASS.items():
        out[ord(c)] = i
    return out


def trigram_counts(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Counts of class trigrams over the lower-cased texts, a boundary pair before and after each."""
    points = np.frombuffer(" ".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(SIZE, np.int64)
    for at in range(0, len(points), PIECE):  # two characters again, which the first of a piece follow
        code = table[points[max(0, at - 2) : at + PIECE]].astype(np.int32)
        if not at:
            code = np.concatenate([np.zeros(2, np.int32), code])
        out += np.bincount((code[:-2] * BASE + code[1:-1]) * BASE + code[2:], minlength=SIZE)
    return out


def suspicious(text: str) -> bool:
    """Whether a text can hold a span at all: a sign or digit, a point within a word, a letter three times, or lone letters."""
    if SIGN.search(text) or POINT.search(text):
        return True
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(p) > 2 and ((p[2:] == p[1:-1]) & (p[2:] == p[:-2]) & (p[2:] > 64)).any():
        return True
    return bool(SINGLE.search(text))


def lattice(span: str) -> list[list[tuple[str, int, float]]]:
    """For each part of a span its readings (what is written, its class, cost): nothing, a letter, or the end of a word.

    A letter or sign repeated more than three times counts as three; marks that follow on one another are one part."""
    found = list(PARTS.finditer(span))
    widths = [len(m.group()) for m in found if m["mark"]]
    narrow = min(widths, default=0)
    out: list[list[tuple[str, int, float]]] = []
    for m in found:
        s = m.group()
        if m["mark"]:
            wide = len(s) > narrow
            out.append([("", -1, COST_JOIN_WIDE if wide else COST_SKIP_MARK), (" ", 0, 0.0 if wide else COST_BREAK)])
            continue
        ch, run = s[0], len(s)
        for k in range(min(run, 3)):
            if ch in READS:
                out.append([*((x, CLASS.get(x, OTHER), COST_READ) for x in READS[ch]), ("", -1, COST_SKIP_REPEAT if k else COST_SKIP_SIGN)])
            elif not LETTER.match(ch):
                out.append([("", -1, COST_SKIP_MARK)])
            elif k:
                out.append([(ch, CLASS.get(ch, OTHER), COST_KEEP_REPEAT if run > 2 else 0.0), ("", -1, COST_SKIP_REPEAT if run > 2 else COST_SKIP_DOUBLE)])
            else:
                out.append([(ch, CLASS.get(ch, OTHER), 0.0)])
    return out


def _written(node: tuple | None) -> str:
    out = []
    while node:
        node, x = node
        out.append(x)
    return "".join(reversed(out))


class Model:
    """Log-probabilities of a letter class after two others, from counts with a backoff to shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(BASE, BASE, BASE).astype(float)
        uni = (c.sum((0, 1)) + 1) / (c.sum() + BASE)
        prior = np.tile(uni, (BASE, 1))
        prior[OTHER] = (uni + (np.arange(BASE) == OTHER)) / 2  # letters without a class of their own follow one another, seen or not
        two = (c.sum(0) + 5 * prior) / (c.sum((0, 2))[:, None] + 5)
        three = (c + 5 * two[None]) / (c.sum(2)[:, :, None] + 5)
        self.log = np.log(three).ravel().tolist()
        self.seen: dict[str, str] = {}

    def decode(self, span: str) -> str:
        """The likeliest letters of a span, lower case, with a space between words."""
        if len(span) > SHORT:
            return self._decode(span)
        if span not in self.seen:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            self.seen[span] = self._decode(span)
        return self.seen[span]

    def _decode(self, span: str) -> str:
        if sum(1 for _, _ in zip(LETTER.finditer(span), range(2), strict=False)) < 2:
            return span
        return self.viterbi(lattice(span))

    def viterbi(self, parts: list[list[tuple[str, int, float]]]) -> str:
        """A state is the last two classes; a path is a score and a chain of what it wrote, the latest first."""
        log, done = self.log, []
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for i, readings in enumerate(parts, 1):
            new: dict[int, tuple[float, tuple | None]] = {}
            for key, (score, path) in states.items():
                for x, c, cost in readings:
                    if c < 0:
                        k, s = key, score - cost
                    elif c == 0 and key % BASE == 0:
                        continue  # one end of a word is enough
                    else:
                        k, s = key % BASE * BASE + c, score + log[key * BASE + c] - cost
                    if k not in new or new[k][0] < s:
                        new[k] = (s, (path, x) if x else path)
            states = new
            if i % FLUSH == 0:
                texts = [_written(p) for _, p in states.values()]
                shared = os.path.commonprefix(texts)
                done.append(shared)
                for k, t in zip(list(states), texts, strict=True):
                    rest = None
                    for x in t[len(shared) :]:
                        rest = (rest, x)
                    states[k] = (states[k][0], rest)
        best = max((score + (log[key * BASE] if key % BASE else 0.0), _written(path)) for key, (score, path) in states.items())
        return "".join([*done, best[1]])

    def restore(self, text: str) -> str:
        """The text in lower case with each disguised span read as its likeliest words."""
        return SPAN.sub(lambda m: self.decode(m.group()) or m.group(), text.lower())
