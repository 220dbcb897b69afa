"""Periodic runs of words, by Lyndon roots and longest common extensions from suffix trees.

A *run* is a stretch of consecutive words with a smallest period q (words q apart are the same) that cannot be extended
on either side. Every run that repeats its period at least twice contains a *Lyndon root*: a word that starts at some
place, has length q, and is the longest Lyndon word starting there, in the order of symbols or in the reverse order. So
one candidate for each place and order finds all runs. The end of the longest Lyndon word at a place is the next place
whose suffix is smaller. A candidate is extended in both directions by the longest common extension of its two ends:
Ukkonen's algorithm builds the suffix trees of the words and of their reversal, a tour of each tree lists its leaves with
the string depth of the lowest common ancestor of neighbours, and a table of minima over powers of two answers any lowest
common ancestor in constant time.

The trees are built for the stretches of a document that can hold a run: in a run of period q and at least ``times`` times
that length, every word but the first q was seen at most q words before. Stretches where that holds for no q are out, and
prose mostly is; a run always lies in one stretch, and what is longest there is longest in the document. Words are compared
as such, not by hashes. The work is a map over whole texts without a shuffle, and memory is that of one text's stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices

TIMES = 4
SHORTEST = 6
RUNS = "array<struct<start:long,length:long,period:long>>"


class SuffixTree:
    """Ukkonen's suffix tree of symbols from 1 on, ended by the symbol 0 that it adds.

    A node is a number, 0 the root. The edge into it carries the symbols ``start`` to ``end`` (exclusive); a leaf's goes
    to the end. ``edges`` maps node * alphabet + first symbol to the child.
    """

    def __init__(self, symbols: list[int]) -> None:
        text = self.text = [*symbols, 0]
        size = self.alphabet = max(text) + 1
        total = len(text)
        start, end, link = [0], [0], [0]
        edges: dict[int, int] = {}
        node = edge = length = pending = 0
        for i, symbol in enumerate(text):
            last = 0  # the inner node made last, which waits for its suffix link
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * size + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(total)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    span = end[child] - start[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[start[child] + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start += (start[child], i)
                    end += (start[child] + length, total)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * size + symbol] = split + 1
                    start[child] += length
                    edges[split * size + text[start[child]]] = child
                    if last:
                        link[last] = split
                    last = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.start, self.end, self.edges = start, end, edges
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self._children = np.fromiter(edges.values(), np.int64, len(edges))
        self._parents, self._symbols = keys // size, keys % size

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their leaves, and the string depth where each parts from the one before.

        Children are visited in the order of their symbols, or in the reverse order; the end comes first in both.
        """
        rank = np.where(self._symbols == 0, -self.alphabet, -self._symbols) if descending else self._symbols
        order = np.lexsort((rank, self._parents))
        children = self._children[order]
        first = np.searchsorted(self._parents[order], np.arange(len(self.start) + 1)).tolist()
        below = children.tolist()
        start, end, total = self.start, self.end, len(self.text)
        suffixes, parted = [], []
        depth = 0  # where the leaf reached next parts from the one before
        # A node, the string depth of its parent, and whether it is its parent's first child.
        stack = [(c, 0, c == below[0]) for c in reversed(below[first[0] : first[1]])]
        while stack:
            node, above, is_first = stack.pop()
            if not is_first:
                depth = above
            a, b = first[node], first[node + 1]
            if a == b:
                suffixes.append(start[node] - above)
                parted.append(depth)
            else:
                at = above + end[node] - start[node]
                stack += [(c, at, False) for c in below[b - 1 : a : -1]]
                stack.append((below[a], at, True))
        return np.array(suffixes, np.int64).reshape(total), np.array(parted, np.int64)


class CommonExtension:
    """The length of the longest common prefix of any two suffixes of the symbols, in constant time each."""

    def __init__(self, suffixes: np.ndarray, parted: np.ndarray) -> None:
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.minima = [parted.astype(np.int32)]
        while 2 << (len(self.minima) - 1) <= len(parted):
            half, below = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places."""
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank; the last place has the smallest rank and is left out."""
    out = [0] * (len(rank) - 1)
    waiting: list[int] = []
    for place, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = place
        waiting.append(place)
    return out


def runs_of_symbols(symbols: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``times`` periods, by start, then period."""
    n = len(symbols)
    if n < max(times, shortest):
        return np.zeros((0, 3), np.int64)
    known, codes = np.unique(symbols, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    tree = SuffixTree(codes.tolist())
    order, parted = tree.tour()
    forwards = CommonExtension(order, parted)
    reverse_rank = np.empty(n + 1, np.int64)
    reverse_rank[tree.tour(descending=True)[0]] = np.arange(n + 1)
    places = np.arange(n)
    # The ends of the longest Lyndon words, in both orders of the symbols.
    ends = np.concatenate([next_smaller(forwards.rank.tolist()), next_smaller(reverse_rank.tolist())])
    begins = np.concatenate([places, places])
    del tree, reverse_rank
    right = forwards(begins, ends)
    backwards = CommonExtension(*SuffixTree(codes[::-1].tolist()).tour())
    left = backwards(n - begins, n - ends)
    period = ends - begins
    length = ends + right - begins + left
    found = np.stack([begins - left, period, length], axis=1)[length >= np.maximum(shortest, times * period)]
    found = np.unique(found, axis=0)
    return found[:, [0, 2, 1]]


def stretches(codes: np.ndarray, text_of: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (first, last + 1) of the stretches of words outside of which there are no runs; a run lies in one stretch.

    ``codes`` are equal for equal words, ``text_of`` the number of each word's text, ascending.
    """
    n = len(codes)
    order = np.lexsort((np.arange(n), codes, text_of))
    back = np.full(n, n + 1)
    same = (codes[order[1:]] == codes[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    change = np.zeros(n + 1, np.int64)
    most = int(np.bincount(text_of).max()) if n else 0
    reach = 1
    while reach // 2 * times < most:
        # Periods above reach / 2 and up to reach: a run's words after the first period are near their like.
        near = np.concatenate(([False], back <= reach, [False]))
        first = np.flatnonzero(near[1:] & ~near[:-1])
        last = np.flatnonzero(~near[1:] & near[:-1])
        least = reach // 2 + 1
        turn = min(max(shortest // times, least), reach)
        long = last - first >= min(max(shortest, times * q) - q for q in (least, turn, min(turn + 1, reach)))
        np.add.at(change, np.maximum(first[long] - reach, 0), 1)
        np.add.at(change, last[long], -1)
        reach *= 2
    inside = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
    # Texts stand side by side: a stretch that reaches into another text is cut there.
    edge = np.concatenate(([True], text_of[1:] != text_of[:-1], [True])) if n else np.ones(1, bool)
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return np.stack([first, last], axis=1)


def word_codes(words: Words) -> np.ndarray:
    """Equal numbers for equal words, by their bytes."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64)
    # Words and what lies between them, in turn, as one array of spans.
    spans = np.stack([words.starts, words.ends], axis=1).ravel().astype(np.int64)
    data = np.ascontiguousarray(words.data)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(spans), pa.py_buffer(data)])
    return spans.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)


def _joined(raw: bytes, at: np.ndarray, words: Words, kept: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    out = []
    removed = np.add.reduceat(np.append(~kept, False), np.minimum(words.first[:-1], len(kept))) * (words.counts > 0)
    for i in range(len(at) - 1):
        if removed[i]:
            left = np.flatnonzero(kept[words.first[i] : words.first[i + 1]]) + words.first[i]
            out.append(b" ".join([raw[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)]))
        else:  # without an argument, bytes are split at the separators of words
            out.append(b" ".join(raw[at[i] : at[i + 1]].split()))
    return out


def _rows(times: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in slices(batch.column("text")):
                words = Words(data, at)
                codes = word_codes(words)
                text_of = np.repeat(np.arange(last - first), words.counts)
                kept = np.ones(len(codes), bool)
                parts = [np.zeros((0, 3), np.int64)]
                for a, b in stretches(codes, text_of, times, shortest).tolist():
                    found = runs_of_symbols(codes[a:b], times, shortest)
                    found[:, 0] += a
                    for start, length, period in found.tolist():
                        kept[start + period : start + length] = False
                    parts.append(found)
                found = np.concatenate(parts)
                begins = np.searchsorted(found[:, 0], words.first)
                starts = found[:, 0] - words.first[text_of[found[:, 0]]]
                struct = pa.StructArray.from_arrays(
                    [pa.array(starts), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, last - first),
                        pa.array(words.counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), struct),
                        pa.array(_joined(data.tobytes(), at, words, kept), pa.binary()),
                    ],
                    ["id", "n_words", "runs", "kept"],
                )

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, shortest: int = SHORTEST
) -> DataFrame:
    """The periodic runs of words of each text, and the text without their repetitions. One row per input row.

    Columns: the identifier, ``n_words``, ``runs`` (start as a word number from 0, length and smallest period in words, by
    start, then period) and ``collapsed_text`` (the words that no run contains after its own first period, joined by one
    space). A run has at least ``times`` times its period, which is two or more, and ``shortest`` words. Words are
    compared as they are, upper and lower case apart. Null and empty texts have no words, no runs and an empty collapsed
    text. Rows are treated one by one, so repeated rows and rows that share an identifier each get their own result, and
    a null identifier stays null. An empty table gives an empty result. Other columns are not read. A text must fit into
    a task's memory, with some hundred bytes more for each word of its periodic stretches.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_rows(times, shortest), f"id {id_type}, n_words long, runs {RUNS}, kept binary")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("kept").cast("string").alias("collapsed_text"))
