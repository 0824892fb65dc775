"""URL filter: glob rules packed into one multiword bit-parallel automaton.

A canonical URL is ``host SEP path``. Every rule is a glob over it (``*`` any run, but in the host part no SEP; ``?`` one
character) and is laid out as consecutive states; all states of all rules lie in one array of 64-bit words. For each
byte c there is a mask of the states it enters (Shift-And) and one of the states it stays in (a star). All rules advance
together, one byte of every URL of the batch at a time: ``D = ((D << 1) & enter[c]) | (D & stay[c])``. The state space
depends on the rules alone.

Defined results: null url, or one without ``://``: host and path empty; a host that is empty matches no rule and is
blocked; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x01"
W = np.uint64


class Automaton:
    """All globs at once. ``match(urls)`` gives a boolean matrix, a row for each url and a column for each glob."""

    def __init__(self, globs: list[str]) -> None:
        states: list[tuple[bytes | None, bool]] = []  # byte that enters a state (None: any), first of its glob
        stay: list[str] = []
        self.final: list[int] = []
        for glob in globs:
            states.append((b"", True))
            stay.append("")
            for c in glob:
                if c == "*":
                    stay[-1] = "*"
                else:
                    for b in b"\x00" if c == "?" else c.encode():
                        states.append((None if c == "?" else bytes([b]), False))
                        stay.append("")
            self.final.append(len(states) - 1)
            # a star before the separator doesn't cross it
            seen = False
            for k in range(len(states) - 1, -1, -1):
                if states[k][0] == SEP.encode():
                    seen = True
                elif seen and stay[k] == "*":
                    stay[k] = "host"
                if states[k][1]:
                    break
        self.words = max(1, -(-len(states) // 64))
        self.enter = np.zeros((256, self.words), W)
        self.stays = np.zeros((256, self.words), W)
        self.start = np.zeros(self.words, W)
        sep = SEP.encode()[0]
        for k, ((byte, first), star) in enumerate(zip(states, stay, strict=True)):
            w, bit = k >> 6, W(1) << W(k & 63)
            if first:
                self.start[w] |= bit
            elif byte is None:  # a character: its first byte enters the state, those that follow stay
                self.enter[:0x80, w] |= bit
                self.enter[0xC0:, w] |= bit
                self.stays[0x80:0xC0, w] |= bit
            else:
                self.enter[byte[0], w] |= bit
            if star:
                self.stays[:, w] |= bit
            if star == "host":
                self.stays[sep, w] &= ~bit

    def match(self, urls: list[bytes]) -> np.ndarray:
        n = len(urls)
        order = np.argsort([-len(u) for u in urls], kind="stable")
        length = np.array([len(urls[k]) for k in order], np.int64)
        data = np.frombuffer(b"".join(urls[k] for k in order), np.uint8)
        at = np.concatenate(([0], np.cumsum(length)))[:-1].astype(np.int64)
        d = np.tile(self.start, (n, 1))
        live = n
        for i in range(int(length[0]) if n else 0):
            while live and length[live - 1] <= i:
                live -= 1
            c = data[at[:live] + i]
            old = d[:live]
            moved = old << W(1)
            moved[:, 1:] |= old[:, :-1] >> W(63)
            d[:live] = (moved & self.enter[c]) | (old & self.stays[c])
        out = np.zeros((n, len(self.final)), bool)
        for g, k in enumerate(self.final):
            out[order, g] = (d[:, k >> 6] >> W(k & 63)) & W(1) == 1
        return out


def host_column(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "".join(map(chr, range(65, 91)))
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit(""))


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_globs(rule: str) -> list[str]:
    """A ``host/path`` rule as globs: the host itself, and its subdomains."""
    host, slash, path = rule.partition("/")
    return [f"{host}{SEP}{slash}{path}*", f"*.{host}{SEP}{slash}{path}*"]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], blocked: list[str], key: str = "page_id") -> DataFrame:
    """Per row: key, host, path, rule, verdict.

    rules: (verdict, ``host/path``), the longest that fits decides and is named. blocked: globs over ``host`` (no ``/``)
    or ``host/path``; a url that no rule fits is blocked where one of them matches. Characters ``*`` and ``?`` of rules
    are wildcards.
    """
    names = [r for _, r in rules]
    globs = [g for r in names for g in rule_globs(r)]
    n_rules = len(globs)
    for b in blocked:
        host, slash, path = b.partition("/")
        globs.append(f"{host}{SEP}{slash}{path}" if slash else f"{host}{SEP}*")
    rank = sorted(range(len(names)), key=lambda k: len(names[k]))  # longer rules overwrite shorter ones
    verdicts = [v for v, _ in rules]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(globs)
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                hit = machine.match([f"{h}{SEP}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
                best = np.full(len(hosts), -1)
                for k in rank:
                    best[hit[:, 2 * k] | hit[:, 2 * k + 1]] = k
                bad = hit[:, n_rules:].any(axis=1) | np.array([not h for h in hosts], bool)
                rule = [names[k] if k >= 0 else None for k in best]
                verdict = [verdicts[k] if k >= 0 else "block" if b else "allow" for k, b in zip(best, bad, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.col("url").cast("string")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host_column(url).alias("host"), path_column(url).alias("path"))
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
