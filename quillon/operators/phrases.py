"""Vague phrases by similarity, and the reading of loose model output: Arrow functions, as the ratio has no native form.

Defined results: null text has no words, spans or JSON; a phrase without words is never found.
"""

from __future__ import annotations

import difflib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillon.functions.text import has_stop_word, normalize_words
from quillon.operators import vocabulary as v
from quillon.operators.scan import Claims

PHRASES = [(p, "jurisprudencia") for p in v.VAGUE_PRECEDENTS] + [(p, "lei") for p in v.VAGUE_LAWS]
SPANS = "doc string, start int, stop int, match string, phrase string, type string, score double"


@lru_cache(maxsize=100_000)
def normalized(s: str) -> str:
    """The row-wise twin of ``normalize_words``."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
    return " ".join(folded.split()).replace("rn", "m")


def apart(found: list[tuple]) -> list[tuple]:
    """Of (score, start, stop, ...), best score first and then leftmost, those that overlap none taken before; by start."""
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        if not any(f[1] < k[2] and f[2] > k[1] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[1])


LETTERS = 32


@lru_cache(maxsize=100_000)
def letter_counts(s: str) -> np.ndarray:
    """How often each class of letters (code modulo ``LETTERS``) occurs."""
    return np.bincount(np.frombuffer(s.encode("utf-32-le"), np.uint32) % LETTERS, minlength=LETTERS)


@lru_cache(maxsize=10_000)
def places_of(s: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: matching blocks hold no more characters."""
    places, full = places_of(a), (1 << len(a)) - 1
    left = full
    for c in b:
        hit = left & places.get(c, 0)
        left = ((left + hit) | (left - hit)) & full
    return len(a) - left.bit_count()


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def best_apart(windows: list[tuple], least: float) -> list[tuple]:
    """``apart`` of the windows (most, start, stop, norm, words, phrase, type) that score ``least``, as (score, start, stop,
    phrase, type); most: no less than the score.

    The window that may score best comes first. Its score is bounded by the common subsequence, then computed, only while
    nothing better is left and no better one overlaps it; it is taken once its own score stands first.
    """
    heap = [(-most, 0, start, stop, k) for k, (most, start, stop, *_) in enumerate(windows)]
    heapq.heapify(heap)
    claims, kept = Claims(), []
    while heap:
        most, step, start, stop, k = heapq.heappop(heap)
        if not claims.free(start, stop):
            continue
        _, _, _, norm, words, phrase, kind = windows[k]
        if step == 2:
            claims.take(start, stop)
            kept.append((-most, start, stop, phrase, kind))
            continue
        score = ratio(norm, words) if step else 2.0 * common(norm, words) / ((len(norm) + len(words)) or 1)
        if score >= least:
            heapq.heappush(heap, (-score, step + 1, start, stop, k))
    return sorted(kept, key=lambda f: f[1])


def find_phrases(texts: list[str], phrases: list[tuple[str, str]], least: float = 0.82) -> list[list[tuple]]:
    """(score, start, stop, phrase, type) of each text. Windows have a phrase's number of words, one fewer or one more.

    A window shares no more letters with a phrase than the counts of both allow. Counts of all windows of all texts come
    from running sums over the words, so that bound is taken at once, letter by letter, and few windows pass it.
    """
    found: list[list[tuple]] = [[] for _ in texts]
    spots = [(d, *m.span()) for d, t in enumerate(texts) for m in re.finditer("\\S+", t)]
    if not spots:
        return found
    plain = [normalized(texts[d][a:b]) for d, a, b in spots]
    of = np.array([d for d, _, _ in spots])
    counts = np.zeros((LETTERS + 1, len(plain) + 1), np.int32)  # at last, words with letters: those have a space between them
    np.cumsum(np.array([letter_counts(w) for w in plain], np.int32).T, axis=1, out=counts[:LETTERS, 1:])
    np.cumsum(np.array([w != "" for w in plain], np.int32), out=counts[LETTERS, 1:])
    by_size: dict[int, list[tuple[str, str, str]]] = {}
    for phrase, kind in phrases:
        n = len(phrase.split())
        for size in {n - 1, n, n + 1} - {0, -1}:
            by_size.setdefault(size, []).append((phrase, kind, normalized(phrase)))
    for size, group in by_size.items():
        if size > len(plain):
            continue
        window = counts[:, size:] - counts[:, :-size]
        window[ord(" ") % LETTERS] += np.maximum(window[LETTERS] - 1, 0)
        length = window[:LETTERS].sum(axis=0)
        whole = of[: len(length)] == of[size - 1 :]
        for phrase, kind, norm in group:
            shared = np.zeros(len(length), np.int32)
            for c, n in enumerate(letter_counts(norm).tolist()):
                if n:
                    shared += np.minimum(window[c], n)
            both = len(norm) + length
            for i in np.flatnonzero(whole & (2 * shared >= least * both) & (both > 0)).tolist():
                words = " ".join(filter(None, plain[i : i + size]))
                found[spots[i][0]].append((2.0 * int(shared[i]) / int(both[i]), spots[i][1], spots[i + size - 1][2], norm, words, phrase, kind))
    return [best_apart(f, least) for f in found]


def phrase_spans(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, least: float = 0.82, key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, start, stop, match, phrase, type, score) of every vague phrase; spans of a document never overlap."""
    wanted = [p for p in phrases if p[0].split()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, rows = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], []
            i = 0
            while i < len(texts):  # a megabyte of text at a time
                j, size = i, 0
                while j < len(texts) and (j == i or size < 1 << 20):
                    size += len(texts[j])
                    j += 1
                once = list(dict.fromkeys(texts[i:j]))
                found = dict(zip(once, find_phrases(once, wanted, least), strict=True))
                for k, t in zip(keys[i:j], texts[i:j], strict=True):
                    rows += [(k, a, b, t[a:b], p, kind, score) for score, a, b, p, kind in found[t]]
                i = j
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in SPANS.split(", ")])

    return docs.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(read, SPANS)


def json_in(chatter: str | None) -> str | None:
    """The first object or array in loose text, without thoughts and code fences; null where none parses."""
    body = re.sub("<think>.*?</think>", "", chatter or "", flags=re.DOTALL)
    body = re.sub("```(?:json)?", "", body)
    opening = re.search("[{\\[]", body)
    if opening is None:
        return None
    body = body[opening.start() :]
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False)


def locate(text: str, snippet: str) -> tuple[int, int] | None:
    """Where a snippet stands: exact, else around the longest shared block of six characters and two fifths of it."""
    at = text.find(snippet)
    if at >= 0:
        return at, at + len(snippet)
    block = difflib.SequenceMatcher(None, text, snippet).find_longest_match(0, len(text), 0, len(snippet))
    if block.size < max(6, 0.4 * len(snippet)):
        return None
    start = max(0, block.a - block.b)
    return start, min(len(text), start + len(snippet))


@F.pandas_udf(StringType())
def json_from_chatter(s: pd.Series) -> pd.Series:
    return s.map(json_in)


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
def locate_snippet(text: pd.Series, snippet: pd.Series) -> pd.DataFrame:
    found = [locate(t, s) if t and s else None for t, s in zip(text, snippet, strict=True)]
    return pd.DataFrame([f or (None, None) for f in found], columns=["start", "stop"]).astype("Int32")


def model_spans(docs: DataFrame, model: Callable[[list[str]], list[str]], key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, start, stop, type) found by any text model: a callable from texts to answers that hold a JSON list of
    objects with ``trecho`` and ``tipo``. Answers that hold none give no spans."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame.columns = ["doc", "text"]
            rows = []
            for doc, body, answer in zip(frame["doc"], frame["text"], model(frame["text"].fillna("").tolist()), strict=True):
                items = json.loads(json_in(answer) or "[]")
                for item in items if isinstance(items, list) else items.get("citacoes", []):
                    spot = locate(body or "", str(item.get("trecho", ""))) if isinstance(item, dict) and item.get("trecho") else None
                    if spot:
                        rows.append((doc, *spot, str(item.get("tipo", ""))))
            yield pd.DataFrame(rows, columns=["doc", "start", "stop", "type"]).astype({"start": "int32", "stop": "int32"})

    return docs.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInPandas(ask, "doc string, start int, stop int, type string")


def accept_paraphrases(candidates: DataFrame, group: str = "type") -> DataFrame:
    """Candidates (original, paraphrase, type, ord) worth keeping: no digit, 10 to 160 characters, not English, not the
    original, and within a group less than 0.85 like every one kept before.

    A group is what one model was asked for, a few hundred rows; that order-dependent choice runs over it in one task.
    """
    clean = F.trim(F.regexp_replace(F.trim("paraphrase"), '^"+|"+$', ""))
    rows = candidates.withColumn("paraphrase", clean).where(~F.col("paraphrase").rlike("[0-9]") & F.length("paraphrase").between(10, 160) & ~has_stop_word(F.col("paraphrase"), v.ENGLISH_HINTS))
    rows = rows.where(normalize_words(F.col("paraphrase")) != normalize_words(F.col("original")))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        mask = []
        for p in (frame := frame.sort_values("ord"))["paraphrase"]:
            n = normalized(p)
            mask.append(all(difflib.SequenceMatcher(None, n, k).ratio() < 0.85 for k in kept))
            if mask[-1]:
                kept.append(n)
        return frame[mask]

    return rows.groupBy(group).applyInPandas(choose, rows.schema)
