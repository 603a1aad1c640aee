"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, lower
case. Every sequence of GRAM words of a test item (fewer in items under 6 words, see
seed_length) is a seed, so each copy with at most 1 - SIMILARITY of the words changed, left
out or put in keeps one whole. It is a seed however many documents hold it:
the sequences that an edited copy leaves whole are often the frequent ones, so a choice by
rarity would lose it beside many exact copies. A scan of the corpus joins seeds to documents,
clusters the hits on a diagonal and aligns the item with the words around (match 2, mismatch
and gap -1) where these hold enough of the item's words. A document is contaminated by an
item if the alignment matches at least SIMILARITY of the item's words.

The test items are the query set: they go to the executors in blocks of at most BLOCK_WORDS
words, one scan each and one after the other, so what is broadcast and what the driver holds
are bounded whatever their number. The corpus is never shuffled; a hot passage is aligned once
per task and text around it. Hits of a text that repeats part of an item over and over chain
without end, so a chain is aligned in overlapping windows, each of at most two items' length
and the slack around. Items longer than PIECE words are aligned in pieces of equal length (one
word more or less), and one contaminated piece counts.

Defined cases: items without a word and null items match nothing; null texts hold nothing; a text
of any length is searched whole; null doc_ids are returned as null; repeated rows are judged each;
repeated items give a row for each item_id; of equally similar passages the higher score, then
the first one is reported; either table empty: empty result (clean: docs as they are); columns other
than doc_id, item_id and text, of any name, are ignored and come back unchanged from clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import U64, hash_spans, mix, spans, text_bytes
from .shared import cut

GRAM, SIMILARITY, PIECE, BLOCK_WORDS, SLACK = 3, 0.8, 256, 500_000, 8
MATCH, MISS = 2, -1
#: Bytes of text worked on at a time, and of windows whose alignments are remembered; hits at a time (those of one text at least).
SLICE, MEMO, HITS = 1 << 21, 1 << 24, 1 << 20
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
FOUND = "doc_id long, item_id long, similarity double, score int, first_word long, last_word long"


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, and where each text's words begin (and the end)."""
    starts, ends = spans(data, off, SEPARATORS)
    return hash_spans(data, starts, ends, SAME), np.searchsorted(starts, off)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about SLICE bytes of text, one row at least: a batch is bounded in rows only."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(upto // SLICE)) + 1
        for i, j in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(i, j - i)


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place."""
    if len(w) < n:
        return np.zeros(0, U64)
    h = np.zeros(len(w) - n + 1, U64)
    for k in range(n):
        h = mix(h * U64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return h


def seed_length(n: int) -> int:
    """At most GRAM, and at most the longest run that is sure to be left in n words after 1 - SIMILARITY of them were edited."""
    edits = int(n * (1 - SIMILARITY) + 1e-9)
    return min(GRAM, -(-(n - edits) // (edits + 1)))


@dataclass
class Index:
    """Pieces of test items, and their grams by length: hash, piece and place, ascending by hash."""

    item: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    marks: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, item: int, w: np.ndarray) -> None:
        if len(w):
            for part in np.array_split(w, -(-len(w) // PIECE)):
                self.item.append(item)
                self.words.append(part)

    def build(self) -> Index:
        """Fills grams."""
        by: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, w in enumerate(self.words):
            n = seed_length(len(w))
            h = gram_hashes(w, n)
            by.setdefault(n, []).append((h, np.full(len(h), k), np.arange(len(h))))
        for n, parts in by.items():
            h, piece, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((place, piece, h))
            self.grams[n] = (h[order], piece[order], place[order])
            self.marks[n] = np.zeros(1 << 20, bool)
            self.marks[n][(h >> U64(44)).astype(np.int64)] = True
        return self

    def hits(self, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in w, and where in grams[n] the hash of the n words there begins."""
        h = gram_hashes(w, n)
        at = np.flatnonzero(self.marks[n][(h >> U64(44)).astype(np.int64)])
        known = self.grams[n][0]
        if not len(known) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        same = known[where] == h[at]
        return at[same], where[same]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: (score, matched words, first and last+1 word of text)."""
    idx = np.arange(len(text) + 1)
    table = np.zeros((len(item) + 1, len(text) + 1), np.int64)
    for i, word in enumerate(item, 1):
        step = np.maximum(0, table[i - 1] + MISS)
        step[1:] = np.maximum(step[1:], table[i - 1][:-1] + np.where(text == word, MATCH, MISS))
        table[i] = np.maximum.accumulate(step - MISS * idx) + MISS * idx
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, matched, end = int(table[i, j]), 0, int(j)
    while table[i, j] > 0:
        if i and j and table[i, j] == table[i - 1, j - 1] + (MATCH if item[i - 1] == text[j - 1] else MISS):
            matched += int(item[i - 1] == text[j - 1])
            i, j = i - 1, j - 1
        elif i and table[i, j] == table[i - 1, j] + MISS:
            i -= 1
        else:
            j -= 1
    return score, matched, int(j), end


def windows(first: int, last: int, size: int) -> list[tuple[int, int]]:
    """The range of a chain's beginnings in ranges of at most `size`, each sharing its end with the next."""
    return [(at, min(at + size, last)) for at in range(first, max(last, first + 1), size)]


class Finder:
    """Contaminations in batches of texts; alignments of equal words are done once."""

    def __init__(self, index: Index):
        self.index, self.done, self.held = index, {}, 0

    def find(self, column: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item, similarity, score, first word, last word), the best per row and item."""
        data, off = lowered(column)
        w, begin = words(data, off)
        seeds, load = [], np.zeros(len(column) + 1, np.int64)
        for n, (known, piece, place) in self.index.grams.items():
            at, where = self.index.hits(w, n)
            doc = np.searchsorted(begin, at, "right") - 1
            inside = at + n <= begin[doc + 1]
            at, where, doc = at[inside], where[inside], doc[inside]
            many = np.searchsorted(known, known[where], "right") - where if len(where) else where
            np.add.at(load, doc + 1, many)
            seeds.append((piece, place, at, where, doc, many))
        cuts = np.flatnonzero(np.diff(np.cumsum(load)[1:] // HITS)) + 1
        out = []
        for lo, hi in pairwise([0, *cuts.tolist(), len(column)]):
            rows, pieces, starts = [], [], []
            for piece, place, *hits in seeds:
                a, b = np.searchsorted(hits[2], [lo, hi])
                at, where, doc, many = (x[a:b] for x in hits)
                k = np.repeat(where, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                rows.append(np.repeat(doc, many))
                pieces.append(piece[k])
                starts.append(np.repeat(at, many) - place[k])
            if rows:
                out += self._judge(w, begin, *(np.concatenate(x) for x in (rows, pieces, starts)))
        return out

    def _judge(self, w: np.ndarray, begin: np.ndarray, row: np.ndarray, piece: np.ndarray, start: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
        """What find gives, from hits: the row, the piece, and where the piece would begin in w."""
        order = np.lexsort((start, piece, row))
        row, piece, start = row[order], piece[order], start[order]
        if not len(row):
            return []
        size = np.array([len(x) for x in self.index.words])[piece]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]) | (start[1:] - start[:-1] > size[1:] // 2 + SLACK)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        best: dict[tuple[int, int], tuple] = {}
        for r, p, at, to in ((int(row[a]), int(piece[a]), *span) for a, b in zip(first.tolist(), last.tolist()) for span in windows(int(start[a]), int(start[b]), int(size[a]))):
            item, slack = self.index.words[p], SLACK + len(self.index.words[p]) // 4
            lo, hi = max(int(begin[r]), at - slack), min(int(begin[r + 1]), to + len(item) + slack)
            if np.isin(item, w[lo:hi]).mean() < SIMILARITY:
                continue
            score, matched, i, j = self._align(p, w[lo:hi])
            got = (matched / len(item), score, lo + i - int(begin[r]), lo + j - 1 - int(begin[r]))
            key = (r, self.index.item[p])
            if got[0] >= SIMILARITY and (key not in best or (-got[0], -got[1], got[2]) < (-best[key][0], -best[key][1], best[key][2])):
                best[key] = got
        return [(r, i, *got) for (r, i), got in sorted(best.items())]

    def _align(self, piece: int, text: np.ndarray) -> tuple[int, int, int, int]:
        key = (piece, text.tobytes())
        if key not in self.done:
            if self.held > MEMO:
                self.done, self.held = {}, 0
            self.held += len(key[1])
            self.done[key] = align(self.index.words[piece], text)
        return self.done[key]


def index_blocks(items: DataFrame) -> Iterator[Index]:
    """The test items (item_id, text) in blocks of at most BLOCK_WORDS words (one item at least)."""
    index, held = Index(), 0
    for r in items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        w, _ = words(*lowered(pa.array([r.text])))
        if held and held + len(w) > BLOCK_WORDS:
            yield index.build()
            index, held = Index(), 0
        index.add(r.item_id, w)
        held += len(w)
    if held:
        yield index.build()


def _find(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index)
        for batch in slices(batches):
            found = finder.find(batch.column("text"))
            ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            rest = list(zip(*(f[1:] for f in found))) if found else [()] * 5
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(rest, kinds))], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _drop(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index)
        for batch in slices(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[f[0] for f in finder.find(batch.column("text"))]] = False
            yield batch.filter(pa.array(keep))

    return run


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, score, first_word, last_word: a row per document and item that it holds."""
    out = None
    for index in index_blocks(items):
        found = cut(docs.select("doc_id", "text").mapInArrow(_find(index), FOUND), "contaminated")
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item, unchanged. With several blocks of items what is left is written after each."""
    first = True
    for index in index_blocks(items):
        docs = (docs if first else cut(docs, "clean")).mapInArrow(_drop(index), docs.schema)
        first = False
    return docs
