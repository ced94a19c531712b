"""Cutting long texts into pieces at natural boundaries, by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("paragraph", "sentence", "word", "forced")
#: Cost of a cut of each kind; a forced cut costs more than any number of natural ones in one text can.
PENALTY = (0.0, 1.0, 4.0, 1e9)
#: Cost of a piece that leaves no room for the whole overlap, and weight of the squared relative size error.
CRAMPED, IMBALANCE = 60.0, 10.0

# Every run of signs or blanks is tried once, from its begin, so that long runs cost no more than their length.
_STRONG = re.compile(r"\n[ \t\r\n]*+|(?<![.!?…])[.!?…]++[\"'”’»)\]]*+[ \t\r]++")
_BLANKS = re.compile(r"[ \t\r\n]+")


def boundaries(text: str, limit: int, all_words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, with 0 and its end, and their kinds (places in :data:`KINDS`).

    These are all paragraph and sentence ends; word ends, all or those in stretches of more than a quarter of ``limit`` without
    the former; and, only inside a run of more than ``limit`` characters without white space, forced places on a grid of a
    fortieth of ``limit``, as inside such a run no place is better than another. Two places that follow each other are never
    more than ``limit`` apart.
    """
    n = len(text)
    found: dict[int, int] = {}
    strong = [(m.end(), 0 if "\n" in m.group() else 1) for m in _STRONG.finditer(text)]
    at = 0
    for end, kind in [*strong, (n, -1)]:
        if all_words or end - at > limit // 4:
            _word_ends(text, at, end, limit, found)
        if 0 < end < n:
            found[end] = min(kind, found.get(end, 9))
        at = end
    places = sorted(found)
    return np.array([0, *places, n]), np.array([0, *(found[p] for p in places), 0])


def _word_ends(text: str, begin: int, end: int, limit: int, found: dict[int, int]) -> None:
    step = max(1, limit // 40)
    at = begin
    for m in _BLANKS.finditer(text, begin, end):
        _forced(at, m.start(), limit, step, found)
        if m.end() - m.start() > 1 or m.end() - at > limit // 2:
            places = {m.start(), m.end(), *range(m.start(), m.end(), step)}
        else:
            places = {m.end()}
        for p in places:
            if 0 < p < len(text):
                found.setdefault(p, 2)
        at = m.end()
    _forced(at, end, limit, step, found)


def _forced(begin: int, end: int, limit: int, step: int, found: dict[int, int]) -> None:
    if end - begin > limit:
        for p in range(begin + step, end, step):
            found[p] = 3


def _least_cost(text: str, limit: int, overlap: int, all_words: bool) -> tuple[np.ndarray, np.ndarray, list[int], float]:
    """(places, kinds, the chosen ones, their cost) of the cheapest division over the boundaries."""
    n = len(text)
    places, kinds = boundaries(text, limit, all_words)
    penalty = np.array(PENALTY)[kinds]
    penalty[-1] = 0
    room = limit - overlap
    ideal = n / max(1, -(-n // room))
    cost = np.full(len(places), np.inf)
    back = np.zeros(len(places), np.int64)
    cost[0] = 0
    lows = np.searchsorted(places, places - limit)
    for j in range(1, len(places)):
        low = lows[j]
        size = places[j] - places[low:j]
        total = cost[low:j] + IMBALANCE * (size / ideal - 1) ** 2
        total[(size > room) & (places[low:j] > 0)] += CRAMPED
        best = int(total.argmin())
        cost[j] = total[best] + penalty[j]
        back[j] = low + best
    cuts = [len(places) - 1]
    while cuts[-1]:
        cuts.append(int(back[cuts[-1]]))
    cuts.reverse()
    return places, kinds, cuts, float(cost[-1])


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, repeated, kind) of the pieces of ``text``; the first ``repeated`` characters also end the piece
    before, ``kind`` is that of the cut at ``end``, or -1 at the end of the text."""
    n = len(text)
    if n <= limit:
        return [(0, n, 0, -1)]
    places, kinds, cuts, cost = _least_cost(text, limit, overlap, False)
    if cost > PENALTY[2]:
        # A division that uses a word end left out so far costs at least one such cut, and so might be cheaper than this one.
        places, kinds, cuts, cost = _least_cost(text, limit, overlap, True)
    pieces = []
    for a, b in zip(cuts, cuts[1:]):
        begin, end = int(places[a]), int(places[b])
        start = begin
        if pieces:
            most = max(begin - overlap, end - limit, pieces[-1][0])
            start = _overlap_start(text, most, begin)
        pieces.append((start, end, begin - start, int(kinds[b]) if end < n else -1))
    return pieces


def _overlap_start(text: str, most: int, cut: int) -> int:
    """The first place from ``most`` on where a word begins; ``most`` itself if none does before ``cut``."""
    if most <= 0:
        return 0
    if most >= cut or text[most - 1] in " \t\r\n":
        return min(most, cut)
    m = _BLANKS.search(text, most, cut)
    if m and m.end() < cut:
        return m.end()
    return most if not m else cut


def _runner(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for no, (begin, end, repeated, kind) in enumerate(split(text, limit, overlap)):
                    rows.append((key, no, begin, end, repeated, KINDS[kind] if kind >= 0 else "end", text[begin:end] if with_text else None))
                held += len(text)
                if held > 4_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


_TYPES = (("id", pa.int64()), ("piece_no", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("repeated", pa.int32()), ("cut", pa.string()), ("piece", pa.string()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _TYPES)], names=[n for n, _ in _TYPES])


def split_long(df: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = 2000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """(id, piece_no, begin, end, repeated, cut, piece) of every text of more than ``limit`` characters.

    Pieces have at most ``limit`` characters, their first ``repeated`` (at most ``overlap``) characters included that also
    end the piece before. The cuts are those of least total cost, found by dynamic programming over the boundary
    positions of the whole text: paragraph ends cost nothing, sentence ends little, word ends more, cuts inside a word
    so much that they occur only in a run of more than ``limit`` characters without white space; to that comes the
    squared relative distance of each piece from equal sizes. ``cut`` is the kind of boundary a piece ends at
    (``end`` for the last). Begin and end count characters. Repeated parts begin at a word where one begins.

    A text is cut where it lies, without any shuffle; a very long text costs time in proportion to its length.
    Defined cases: null, empty and short texts give no rows; texts of blanks only are cut between blanks; a row that
    comes twice is cut twice; a null identifier is kept; an empty table gives no rows; other columns are ignored.
    ``with_text`` = False leaves ``piece`` null.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > limit)
    return slim.mapInArrow(_runner(limit, overlap, with_text), "id long, piece_no int, begin long, end long, repeated int, cut string, piece string")
