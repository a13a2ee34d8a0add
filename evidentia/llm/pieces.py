"""Exact tokenizing of whole texts through a table of already encoded pieces.

A text is cut at spaces where no match of the tokenizer's split pattern can cross the cut; every
distinct piece goes through the library once per worker and its result is kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from evidentia.llm.common import Kept

MARKS = frozenset(".,")
SPACE_BEFORE_SPACE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


def cut(text: str) -> tuple[str, list[str]]:
    """The piece before the first space and the others, each without its leading space.

    A cut is made only between a character that is not white space and a space: split patterns of the
    byte-level kind take a space at the start of a match alone, so none crosses it.
    """
    if SPACE_BEFORE_SPACE.search(text) is None:
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = CUT.split(text)
    return first, [p[1:] for p in rest]


def plain_word(word: str) -> bool:
    """Letters alone, of scripts on which all Unicode versions agree; not the one whose lower case has a mark besides."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0370" and "\u0130" not in word))


def tail(piece: str) -> int:
    """Where the closing commas and full stops of a word start, or 0 if they can't be split off.

    Only after letters alone: there every split pattern used here ends a match.
    """
    word = piece.rstrip(".,")
    return len(word) if len(word) < len(piece) and plain_word(word) else 0


class Table(Kept):
    """Results by piece.

    ``encode`` takes distinct pieces to results, ``join`` puts a word and its closing marks together,
    ``lead`` goes before a piece.
    """

    LIMIT = 1_000_000

    def __init__(self, encode: Callable[[list[str]], Iterable], join: Callable, lead: str):
        super().__init__()
        self.encode, self.join, self.lead = encode, join, lead

    def learn(self, lists: Iterable[list[str]]) -> None:
        """Encode what is new among lists of pieces. Afterwards the table has all of them."""
        every: set[str] = set()
        for pieces in lists:
            every.update(pieces)
        wanted = [p for p in every if p not in self]
        if self.trim(len(wanted)):
            wanted = list(every)
        new = []
        for p in wanted:
            at = tail(p) if p[-1:] in MARKS else 0
            new.append((p[:at] if at else p, p[at:] if at else "", p))
        self.fill(self, {c for c, _, _ in new if c not in self}, self.lead)
        ends: dict = {}
        self.fill(ends, {e for _, e, _ in new if e}, "")
        for core, end, p in new:
            self[p] = self.join(self[core], ends[end]) if end else self[core]

    def fill(self, into: dict, pieces: set[str], lead: str) -> None:
        todo = list(pieces)
        for start in range(0, len(todo), 10_000):
            part = todo[start : start + 10_000]
            into.update(zip(part, self.encode([lead + p for p in part])))


def pair(encode: Callable[[list[str]], Iterable], join: Callable) -> tuple[Table, Table]:
    """Tables of pieces that follow a space and of pieces that start a text, filled side by side."""
    inner, first = Table(encode, join, " "), Table(encode, join, "")
    inner.mates, first.mates = [first], [inner]
    return inner, first
