"""Guess cost of a password: the cheapest segmentation into patterns that a guesser tries.

A value is cut into words, dates, repeats, keyboard walks and brute-force
spans. Each has a cost in bits (log2 of the guesses it takes), each further
segment costs :data:`SPLIT_BITS` more, and dynamic programming over the
positions of the value finds the cheapest cut.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

SPLIT_BITS = 1.0
LONGEST_WORD = 20
LONGEST_UNIT = 16  # of a repeat
SHORTEST_WALK = 3
REFERENCE_YEAR = 2025
LEAST_YEARS = 20

# Words that guessers try first, and the letters that digits and signs stand for.
COMMON = ("password passwd admin root welcome login letmein master secret guest user test changeme default "
          "dragon monkey football baseball sunshine princess shadow superman michael jordan iloveyou trustno "
          "hello freedom whatever computer internet server summer winter spring autumn love token apikey").split()
LEET = str.maketrans("4@310!5$7", "aaeioisst")
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")


def _keyboard() -> dict[str, set[str]]:
    """Keys next to each key: the same row left and right, the rows above and below, half a key over."""
    place = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row) if key != " "}
    at = {v: k for k, v in place.items()}
    steps = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))
    return {key: {at[r + dr, c + dc] for dr, dc in steps if (r + dr, c + dc) in at} for key, (r, c) in place.items()}


_NEXT_TO = _keyboard()
_STEP_BITS = math.log2(sum(map(len, _NEXT_TO.values())) / len(_NEXT_TO))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_REPEAT = re.compile("(.{1,%d}?)\\1+" % LONGEST_UNIT, re.DOTALL)
_PARTED_DATE = re.compile(r"(?=(([0-9]{1,4})([-/._ ])([0-9]{1,2})\3([0-9]{1,4})))")
_PACKED = re.compile(r"(?=([0-9]{4,8}))")


class Segment(NamedTuple):
    start: int
    end: int
    kind: str
    bits: float


def _char_bits(c: str) -> float:
    """One character by brute force: digits, small and capital letters, other ASCII, all else."""
    size = (10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000)
    return math.log2(size)


def _case_bits(text: str) -> float:
    """Ways to spread the capitals; one bit for a leading or all capitals."""
    upper = sum("A" <= c <= "Z" for c in text)
    if not upper:
        return 0.0
    letters = upper + sum("a" <= c <= "z" for c in text)
    if upper == letters or upper == 1 and "A" <= text[0] <= "Z":
        return 1.0
    return math.log2(sum(math.comb(letters, i) for i in range(1, min(upper, letters - upper) + 1)))


def _year(number: int) -> int:
    return number if number > 99 else number + (1900 if number > 50 else 2000)


def _date_years(a: str, b: str, c: str) -> list[int]:
    """Years that three numbers may give: day, month and year, or month, day and year, or the year first."""
    found = []
    for day, month, year in ((a, b, c), (b, a, c), (c, b, a)):
        if (1 <= int(day) <= 31 and 1 <= int(month) <= 12 and len(day) <= 2 and len(month) <= 2
                and len(year) in (2, 4) and 1000 <= _year(int(year)) <= 2099):
            found.append(_year(int(year)))
    return found


def _year_bits(year: int) -> float:
    return math.log2(max(abs(year - REFERENCE_YEAR), LEAST_YEARS))


def dates(text: str) -> list[Segment]:
    """Years (19.., 20..), dates with separators and packed dates of 4 to 8 digits, at every place."""
    out = []
    day_bits = math.log2(365)
    for m in _PARTED_DATE.finditer(text):
        years = _date_years(m[2], m[4], m[5])
        if years:
            out.append(Segment(m.start(), m.start() + len(m[1]), "date", day_bits + 2 + min(map(_year_bits, years))))
    for m in _PACKED.finditer(text):
        digits, at = m[1], m.start()
        if digits[:2] in ("19", "20"):
            out.append(Segment(at, at + 4, "date", _year_bits(int(digits[:4]))))
        for n, cuts in ((6, ((2, 4),)), (8, ((2, 4), (4, 6)))):
            if len(digits) >= n:
                years = [y for i, j in cuts for y in _date_years(digits[:i], digits[i:j], digits[j:n])]
                if years:
                    out.append(Segment(at, at + n, "date", day_bits + min(map(_year_bits, years))))
    return out


def keyboard_walks(text: str) -> list[Segment]:
    """Longest runs of neighbouring keys; a turn costs a step's choice, the rest start and length."""
    keys = text.translate(_LOWER).translate(SHIFTED)
    out, start, turns, way = [], 0, 0, None
    where = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row)}
    for i in range(1, len(keys) + 1):
        step = None
        if i < len(keys) and keys[i] in _NEXT_TO.get(keys[i - 1], ()):
            (r0, c0), (r1, c1) = where[keys[i - 1]], where[keys[i]]
            step = r1 - r0, c1 - c0
        if step is not None:
            turns += step != way
        elif i - start >= SHORTEST_WALK:
            own = text[start:i]
            shifted = any(k != c for k, c in zip(keys[start:i], own, strict=True))
            out.append(Segment(start, i, "walk", math.log2(len(_NEXT_TO)) + math.log2(i - start)
                               + turns * _STEP_BITS + shifted))
        if step is None:
            start, turns = i, 0
        way = step
    return out


class GuessCost:
    """Costs under a dictionary ``rank`` of lower-case words (1: tried first)."""

    def __init__(self, rank: dict[str, int]):
        self.bits_of = {w: math.log2(r) for w, r in rank.items() if len(w) <= LONGEST_WORD}
        for r, w in enumerate(COMMON, 2):
            self.bits_of[w] = min(self.bits_of.get(w, math.inf), math.log2(r))
        self.lengths = sorted({len(w) for w in self.bits_of})

    def words(self, text: str) -> list[Segment]:
        """Dictionary words at every place: as they are, spelled with digits and signs, or backwards."""
        plain = text.translate(_LOWER)
        spelled = plain.translate(LEET)
        out = []
        for at in range(len(text)):
            for n in self.lengths:
                end = at + n
                if end > len(text):
                    break
                ways = []
                for form in {plain[at:end], spelled[at:end]}:
                    swaps = sum(a != b for a, b in zip(form, plain[at:end], strict=True))
                    for word, more in ((form, 0), (form[::-1], 1)):
                        if word in self.bits_of:
                            ways.append(self.bits_of[word] + swaps + more)
                if ways:
                    out.append(Segment(at, end, "word", min(ways) + _case_bits(text[at:end])))
        return out

    def repeats(self, text: str) -> list[Segment]:
        """A unit again and again: the unit's own cost and the number of times."""
        return [Segment(m.start(), m.end(), "repeat",
                        self.cost(m[1]) + math.log2((m.end() - m.start()) // len(m[1])))
                for m in _REPEAT.finditer(text)]

    def segments(self, text: str) -> list[Segment]:
        """The cheapest cut of ``text``; their bits and the splits between them sum to its cost."""
        ending: dict[int, list[Segment]] = {}
        for s in (*self.words(text), *dates(text), *keyboard_walks(text), *(self.repeats(text) if len(text) > 1 else ())):
            ending.setdefault(s.end, []).append(s)
        n = len(text)
        best = [0.0] * (n + 1)
        last: list[Segment | None] = [None] * (n + 1)
        open_cost, open_at = math.inf, 0  # cheapest cut whose last segment is a brute-force span up to here
        for j in range(1, n + 1):
            one = _char_bits(text[j - 1])
            fresh = best[j - 1] + (SPLIT_BITS if j > 1 else 0.0)
            if fresh < open_cost:
                open_cost, open_at = fresh, j - 1
            open_cost += one
            best[j] = open_cost
            before = best[open_at] + (SPLIT_BITS if open_at else 0.0)
            last[j] = Segment(open_at, j, "brute", open_cost - before)
            for s in ending.get(j, ()):
                cost = best[s.start] + (SPLIT_BITS if s.start else 0.0) + s.bits
                if cost < best[j]:
                    best[j], last[j] = cost, s
        out, at = [], n
        while at:
            out.append(last[at])
            at = last[at].start
        return out[::-1]

    def cost(self, text: str) -> float:
        """log2 of the guesses for the whole of ``text`` (empty: 0)."""
        parts = self.segments(text)
        return sum(s.bits for s in parts) + SPLIT_BITS * max(0, len(parts) - 1)
