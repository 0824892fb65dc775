"""Reading a text by hand: folded copies, and steps forwards and backwards from a place.

Every step takes a place and returns another (or -1), so that rules read as the order in which a citation is written. A
folded text has the length of its original, so places agree.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left

import numpy as np

from quillon.operators import vocabulary as v


def _fold_table() -> dict[int, str]:
    out = {}
    for code in range(0x41, 0x180):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if chr(code).isalpha() and chr(code) not in v.ORDINALS and len(base) == 1 and base != chr(code):
            out[code] = base
    return out


_FOLD = _fold_table()
_CODES = np.arange(0x180, dtype="<u4")
_CODES[list(_FOLD)] = [ord(c) for c in _FOLD.values()]
_LATIN = bytes(c if c < 256 else 0 for c in _CODES[:256].tolist())
_BEYOND = [chr(c) for c in range(256) if _CODES[c] > 255]


def fold(text: str) -> str:
    """Lower case without accents, letter by letter."""
    if not any(c in text for c in _BEYOND):
        try:
            return text.encode("latin-1").translate(_LATIN).decode("latin-1")
        except UnicodeEncodeError:
            pass
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < len(_CODES), _CODES[np.minimum(codes, len(_CODES) - 1)], codes).tobytes().decode("utf-32-le", "surrogatepass")


def letter(s: str, i: int) -> bool:
    return 0 <= i < len(s) and s[i].isalpha() and s[i] not in v.ORDINALS


def alone(s: str, i: int) -> bool:
    """No letter or digit stands at the place."""
    return not (0 <= i < len(s) and s[i].isalnum())


def over(s: str, i: int, chars: str = "") -> int:
    """Past white space and ``chars``."""
    while i < len(s) and (s[i].isspace() or s[i] in chars):
        i += 1
    return i


def back(s: str, i: int, chars: str = "") -> int:
    """Before white space and ``chars``."""
    while i > 0 and (s[i - 1].isspace() or s[i - 1] in chars):
        i -= 1
    return i


def optional(s: str, i: int, *options: str) -> int:
    """Past the first option that stands here."""
    return next((i + len(o) for o in options if s.startswith(o, i)), i)


def word_before(s: str, i: int) -> int:
    """Where the run of letters that ends here begins."""
    while letter(s, i - 1):
        i -= 1
    return i


def word_end(s: str, i: int) -> int:
    while letter(s, i):
        i += 1
    return i


def marker(s: str, i: int) -> int:
    """Past an ordinal marker, if there is one: n, a dot, a sign, each optional."""
    i = optional(s, over(s, i), "n")
    i = optional(s, over(s, i), ".")
    return over(s, optional(s, over(s, i), *v.ORDINAL_SIGNS))


def marker_before(s: str, i: int) -> int:
    """Before an ordinal marker (n and up to two signs) that ends here, or -1."""
    k = back(s, i)
    for signs in range(3):
        if k > 0 and s[k - 1] == "n" and not letter(s, k - 2):
            return k - 1
        if not (k > 0 and s[k - 1] in v.ORDINAL_SIGNS) or signs == 2:
            return -1
        k -= 1
    return -1


class Claims:
    """Spans that are taken. They never overlap, so the neighbours of a place decide."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []

    def free(self, start: int, stop: int) -> bool:
        k = bisect_left(self.starts, stop)
        return k == 0 or self.stops[k - 1] <= start

    def take(self, start: int, stop: int) -> bool:
        """Claim a span; False where it is not free."""
        if not self.free(start, stop):
            return False
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.stops.insert(k, stop)
        return True


class Form:
    """A way to write a class: its letters, with signs and spaces between them. Dots are optional, and beside dots spaces too."""

    def __init__(self, form: str) -> None:
        loose = "." in form
        self.steps = []
        word = ""
        for c in fold(form) + "\0":
            if c.isalpha():
                word += c
                continue
            if word:
                self.steps.append(("text", word))
                word = ""
            if c == ".":
                self.steps.append(("dot", c))
            elif c == " ":
                self.steps.append(("gap" if loose else "space", c))
            elif c != "\0":
                self.steps.append(("text", c))
        self.steps.reverse()

    def before(self, s: str, i: int) -> int:
        """Where the form begins that ends here, or -1."""
        for kind, piece in self.steps:
            if kind == "text":
                if not s.endswith(piece, 0, i):
                    return -1
                i -= len(piece)
            elif kind == "dot":
                i -= i > 0 and s[i - 1] == piece
            else:
                k = back(s, i)
                if kind == "space" and k == i:
                    return -1
                i = k
        return i


#: What may stand between a class and its number, besides white space; a class may end with these letters too.
_PASSED = " -n" + "".join(v.ORDINAL_SIGNS)


class Classes:
    """The classes of proceedings, read backwards from the place before a number."""

    def __init__(self) -> None:
        self.by_end: dict[str, list[Form]] = {}  # by the last two letters, or the only one
        for form in v.CLASS_FORMS:
            made = Form(form)
            last = next(piece for kind, piece in made.steps if kind == "text")
            self.by_end.setdefault(last[-2:], []).append(made)
        self.qualifiers = tuple(fold(q) for q in v.QUALIFIERS)
        last = [next(piece for kind, piece in form.steps if kind == "text") for forms in self.by_end.values() for form in forms]
        self.tails = {word.rstrip(_PASSED)[-2:] for word in (*last, *self.qualifiers)} | {"-e"}

    def may_end(self, s: str, i: int) -> bool:
        """False where no class can end before a number that stands here: by the letters before all that may lie between."""
        tail = s[max(0, i - 16) : i].rstrip(_PASSED)
        return len(tail) < 2 or tail[-1].isspace() or tail[-2:] in self.tails or tail[-1] in self.tails

    def forms(self, s: str, i: int) -> list[int]:
        """Where forms begin that end here, as words of their own."""
        if i <= 0 or letter(s, i):
            return []
        ends = [i - 1, i] if s[i - 1] == "." and i > 1 else [i]
        found = []
        for end in ends:
            two = (s[max(0, end - 2) : end], s[end - 1]) if end > 1 else (s[end - 1],)
            for form in (form for key in two for form in self.by_end.get(key, ())):
                k = form.before(s, i if form.steps[0][0] == "dot" else end)
                if k >= 0 and not letter(s, k - 1) and (form.steps[0][0] == "dot" or end == i):
                    found.append(k)
        if s[i - 1] == "e" and s[i - 2 : i - 1] == "-" and s[i : i + 1] == "-":
            found.append(i - 1)  # embargos, only within a chain of hyphens
        return found

    def atoms(self, s: str, i: int) -> list[int]:
        """Forms, or forms with a qualifier behind them."""
        found = self.forms(s, i)
        if s.endswith(self.qualifiers, 0, i):
            w = word_before(s, i)
            if s[w:i] in self.qualifiers and w > 0 and s[w - 1].isspace():
                found += self.forms(s, back(s, w))
        return found

    def chain(self, s: str, i: int, least: int) -> int:
        """The first place from ``least`` on at which a chain of classes begins that ends here, or -1."""
        best, todo, seen = -1, [i], set()
        while todo:
            end = todo.pop()
            if end in seen:
                continue
            seen.add(end)
            for start in self.atoms(s, end):
                if start < least:
                    continue
                best = start if best < 0 else min(best, start)
                k = back(s, start)
                if k > 0 and s[k - 1] == "-":
                    todo.append(back(s, k - 1))
                w = word_before(s, k)
                if k < start and s[w:k] in v.CONNECTORS and w > 0 and s[w - 1].isspace():
                    todo.append(back(s, w))
        return best
