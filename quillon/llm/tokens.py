"""Token ids by the tokenizers library, with a bounded memo of the pieces between white space.

Both vocabularies split a text at white space before any merge, so a text's ids are those of its pieces in order. A
piece seen before is looked up, a new one is encoded by the library, many at a time. A text that holds one of the few
control characters on which white space rules differ, or a string of the vocabulary's added tokens (which the library
turns into their ids), is encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np

from quillon.llm.workers import HELD

#: With leading spaces kept: a run of white space but its last character, a word with at most one space, one other.
_KEEP = re.compile(r"\s+(?!\S)| ?\S+|\s")
_ODD = r"[\x1c-\x1f\x85]"


class PieceEncoder:
    """``encode(texts)`` gives one ``uint32`` array per text, equal to the library's with ``add_special_tokens=False``.

    drops_space: the vocabulary ignores white space. memo: pieces held in each of two generations, so that frequent
    pieces outlive a change of generation and memory stays bounded.
    """

    def __init__(self, path: str, memo: int = 700_000, longest: int = 48) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD, *added]), re.IGNORECASE)
        #: Characters one of which every odd string begins with; none where letters of either case begin one.
        starts = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.starts = "" if any(c.isalpha() for c in starts) else "\x1c\x1d\x1e\x1f\x85" + "".join(sorted(starts))
        self.drops_space = not self.whole([" \n "])[0]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size, self.longest = memo, longest
        self.break_ = "|" if self.drops_space else "\n"  # always one token of its own between pieces
        self.break_id = int(np.frombuffer(self.whole([self.break_])[0], np.uint32)[0])
        self.mark = dict(zip(".,", self.whole([".", ","]), strict=True))

    def is_odd(self, text: str) -> bool:
        """Whether the text must be encoded whole; most texts hold none of the characters that could make it so."""
        if self.starts and not any(c in text for c in self.starts):
            return False
        return self.odd.search(text) is not None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: single words as one text with breaks, which costs the library far less than a call for each."""
        out: list[bytes | None] = [None] * len(pieces)
        plain, rest = [], []
        for i in range(0, len(pieces), 2000):  # checked at once; one by one only where some piece isn't a plain word
            cores = [p[1:] if p[0] == " " else p for p in pieces[i : i + 2000]]
            line = " ".join(cores)
            if self.break_ not in line and line.split() == cores and not self.is_odd(line):
                plain += range(i, i + len(cores))
                continue
            for k, core in enumerate(cores, i):
                (plain if self.break_ not in core and core.split() == [core] and not self.odd.search(pieces[k]) else rest).append(k)
        glue = f" {self.break_} " if self.drops_space else self.break_
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            (ids,) = self.tokenizer.encode_batch_fast([glue.join([pieces[k] for k in part])], add_special_tokens=False)
            row = np.array(ids.ids, np.uint32)
            ends = [*np.flatnonzero(row == self.break_id).tolist(), len(row)]
            if len(ends) == len(part):
                a = 0
                for k, b in zip(part, ends, strict=True):
                    out[k] = row[a:b].tobytes()
                    a = b + 1
            else:
                rest += part
        for i in range(0, len(rest), 4096):
            for k, x in zip(rest[i : i + 4096], self.whole([pieces[k] for k in rest[i : i + 4096]]), strict=True):
                out[k] = x
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.memo) > self.size:
            self.memo, self.old = {}, self.memo
        memo, old, mark = self.memo, self.old, self.mark
        out = [self.pieces(t or "") for t in texts]
        fresh: dict[str, None] = {}
        marked: list[str] = []
        for p in set(chain.from_iterable(out)).difference(memo):
            if p in old:
                memo[p] = old[p]
            elif p[-1] in mark and p[:-1].strip(" ").isalpha():  # letters and a closing mark never merge
                marked.append(p)
                if (core := p[:-1]) not in memo:
                    if core in old:
                        memo[core] = old[core]
                    else:
                        fresh[core] = None
            else:
                fresh[p] = None
        new = list(fresh)
        memo.update(zip(new, self.many(new), strict=True))
        for p in marked:
            memo[p] = memo[p[:-1]] + mark[p[-1]]
        got = [np.frombuffer(b"".join(map(memo.__getitem__, ps)), np.uint32) for ps in out]
        for p in chain(new, marked):
            if len(p) > self.longest:  # not worth holding
                memo.pop(p, None)
        return got

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if self.is_odd(text):
            return [text]
        return text.split() if self.drops_space else _KEEP.findall(text)


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in HELD:
        HELD[path] = PieceEncoder(path)
    return HELD[path]


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def spread(texts: list, limit: int = 1 << 20):
    """(first, end) of runs of texts of about ``limit`` characters."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < limit):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j
