"""Toxicity by class-conditional Kneser-Ney models.

Two models of words, one learned from toxic and one from ordinary documents, give each word
a log-likelihood, character by character, and its end. A character's probability depends on
the ORDER - 1 characters before it in its word, or on all of them and the word's beginning
where those are fewer. Both classes interpolate with absolute discounting (DISCOUNT), and both
back off to the same pooled Kneser-Ney continuation counts of orders 1 to SHARED, so an
expression that is rare in one class is judged by what both together know of it and not by its
absence. A word counts once for each document that has it: repeated lines add nothing.

The difference of a word's two log-likelihoods, over distinct words, is what scores a text: it
is length-normalised as the mean over the text's words, and as the means over the one and
the TOP words where it is greatest, so that a few abusive words in a long text aren't averaged
away. The greatest of many words is large by chance, so the logarithm of their number is the
fourth feature. A logistic regression of the four, fitted on labelled documents kept out of
the counts, turns them into a score from 0 to 1.

Counts come from at most FIT_DOCS labelled documents of each class, those with the smallest
hash of their id (a documented bound on fitting only: models are sent to all executors,
and FIT_DOCS bounds them). Every document is scored whole, in one scan, without a shuffle.

Defined cases: null, empty and letterless texts have features 0 and get the score that
goes with them; a text of any length is scored over all its words; repeated rows are scored
each; equal differences are interchangeable, so ties don't matter; labels for unknown documents
and null labels are ignored and contradictory labels count as toxic; without both classes the
score is the class seen, or 0; an empty table gives an empty result; a null doc_id has no label
and is returned as null; columns other than doc_id, text and toxic, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import U64, blocks, hash_spans, mix, spans, sum_by_key
from .shared import crc_mod, cut

ORDER, SHARED, DISCOUNT, TOP, FIT_DOCS, FOLD = 5, 4, 0.9, 3, 4_000, 4
THRESHOLD = 0.3
FEATURES = ["whole", "best", "top", "many"]
RESULT = "doc_id long, held_out boolean, score double, predicted int"
#: Bytes that end a word: ASCII other than letters.
BREAKS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
KNOWN = 1 << 20


def _shift(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(context * U64(0x9E3779B97F4A7C15) + symbol + U64(1))


class Symbols:
    """The symbols of words, ends included, from which grams of each length are hashed.

    Where a word is shorter than the context, its beginning (symbol 0) pads it. Symbols are bytes + 1.
    """

    def __init__(self, words: list[bytes]):
        self.symbols = np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8).astype(np.uint64)
        # a word's first symbol follows a 0; its end is the 0 after it
        self.at = np.arange(1, len(self.symbols))
        since = np.where(self.symbols[:-1] == 0, np.arange(len(self.symbols) - 1), 0)
        self.since = np.maximum.accumulate(since)  # the 0 before each symbol

    def context(self, n: int) -> np.ndarray:
        """The hash of the n - 1 symbols before each one."""
        out = np.full(len(self.at), U64(n))
        for back in range(n - 1, 0, -1):
            place = self.at - back
            out = _shift(out, np.where(place > self.since, self.symbols[np.maximum(place, 0)] + U64(1), U64(0)))
        return out

    def gram(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each n-gram and of its context."""
        context = self.context(n)
        return _shift(context, self.symbols[self.at] + U64(1)), context


class Table:
    """Numbers by 64-bit key; 0 for keys it doesn't hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, total, _ = sum_by_key(keys, values)
        self.values = total.astype(np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0).astype(np.float64)


@dataclass
class Model:
    """Per order and class (0 ordinary, 1 toxic; orders up to SHARED: pooled): counts of grams, of contexts, and distinct followers."""

    tables: list[list[tuple[Table, Table, Table]]]
    symbols: int

    @staticmethod
    def learn(words: list[bytes], counts: np.ndarray) -> Model:
        """counts: (words, 2), how often each word comes in ordinary and in toxic documents."""
        size = np.array([len(w) + 1 for w in words])
        each = np.repeat(counts.astype(np.float64), size, axis=0)
        levels, text = [], Symbols(words)
        for n in range(1, ORDER + 1):
            gram, context = text.gram(n)
            if n <= SHARED:
                # continuation counts: in how many distinct longer grams each one ends
                _, first = np.unique(text.gram(n + 1)[0], return_index=True)
                levels.append([_counted(gram[first], context[first], np.ones(len(first)))] * 2)
            else:
                levels.append([_counted(gram[use], context[use], each[use, c]) for c in (0, 1) for use in [each[:, c] > 0]])
        return Model(levels, 257)

    def differences(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not words:
            return np.zeros(0)
        p = [np.full(sum(len(w) + 1 for w in words), 1.0 / self.symbols)] * 2
        text = Symbols(words)
        for n, level in enumerate(self.tables, 1):
            gram, context = text.gram(n)
            for c in (0, 1):
                count, total, kinds = (t(k) for t, k in zip(level[c], (gram, context, context)))
                mixed = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * p[c]) / np.maximum(total, 1e-9)
                p[c] = np.where(total > 0, mixed, p[c])
        begin = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        return np.add.reduceat(np.log(p[1]) - np.log(p[0]), begin)


def _counted(gram: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[Table, Table, Table]:
    _, first = np.unique(gram, return_index=True)
    return Table(gram, n), Table(context, n), Table(context[first], np.ones(len(first)))


class Scorer:
    """Features of documents; keeps what it worked out for words it has met, up to KNOWN of them."""

    def __init__(self, model: Model):
        self.model, self.keys, self.values = model, np.zeros(0, U64), np.zeros(0)

    def words(self, hashes: np.ndarray, spell) -> np.ndarray:
        """The difference of each word; spell(i) gives the i-th."""
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        value = np.zeros(len(distinct))
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        value[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            value[new] = self.model.differences([spell(i) for i in first[new].tolist()])
            keep = slice(None) if len(self.keys) < KNOWN else slice(0, 0)
            keys, values = np.concatenate([self.keys[keep], distinct[new]]), np.concatenate([self.values[keep], value[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
        return value[number]

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(documents, 4): the mean difference of the distinct words, of the greatest and of the TOP greatest, and the logarithm of their number."""
        n = len(off) - 1
        starts, ends = spans(data, off, BREAKS)
        if not len(starts):
            return np.zeros((n, 4))
        raw = data.tobytes()
        h = hash_spans(data, starts, ends, np.arange(256, dtype=np.uint8))
        each = self.words(h, lambda i: raw[starts[i] : ends[i]])
        doc = np.searchsorted(off, starts, "right") - 1
        order = np.lexsort((h, doc))
        once = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(h[order]) != 0)])]
        each, doc = each[once], doc[once]
        order = np.lexsort((-each, doc))
        each, doc = each[order], doc[order]
        size = np.bincount(doc, minlength=n)
        place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
        mean = lambda use, most: np.bincount(doc[use], each[use], n) / np.maximum(np.minimum(size, most), 1)
        return np.stack([mean(place >= 0, len(doc)), mean(place < 1, 1), mean(place < TOP, TOP), np.log(np.maximum(size, 1))], 1)


def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.utf8_lower(b.column("text"))], names=["doc_id", "text"])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (intercept first) by Newton steps on standardised columns, with a slight ridge."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    x = np.concatenate([np.ones((len(x), 1)), (x - mean) / deviation], 1)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + 1e-3 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), grad)
    slope = w[1:] / deviation
    return np.concatenate([[w[0] - slope @ mean], slope])


def fit(docs: DataFrame, known: DataFrame) -> tuple[Model, np.ndarray] | float:
    """(model, weights) from docs (doc_id, text) and known (doc_id, toxic; one row per id), or the only class seen.

    Only ids are shuffled to choose among them; the texts chosen come by a broadcast of at most 2 * FIT_DOCS ids.
    """
    ids = docs.where(F.col("text").isNotNull()).select("doc_id").distinct().join(known, "doc_id")
    first = [ids.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS) for c in (0, 1)]
    chosen = docs.where(F.col("text").isNotNull()).join(F.broadcast(first[0].unionAll(first[1])), "doc_id")
    held = cut(chosen.select("toxic", "text", F.xxhash64("text").alias("pick"), F.xxhash64("doc_id").alias("rank")), "toxicity-chosen")
    # repeated rows of one id count towards the bound too
    parts = [held.where(F.col("toxic") == c).orderBy("rank", "text").limit(FIT_DOCS).drop("rank") for c in (0, 1)]
    few = cut(parts[0].unionAll(parts[1]).repartition(16, "pick"), "toxicity-fit")
    letters = F.array_remove(F.split(F.regexp_replace(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+", " "), " "), "")
    counted = few.where(F.col("pick") % FOLD != 0).select("toxic", F.explode(F.array_distinct(letters)).alias("w")).groupBy("w").agg(F.sum(1 - F.col("toxic")).alias("o"), F.sum("toxic").alias("t")).toPandas()
    if not counted["t"].sum() or not counted["o"].sum():
        seen = few.agg(F.max("toxic")).first()[0]
        return float(seen or 0)
    counted = counted.sort_values("w")
    model = Model.learn([w.encode() for w in counted["w"]], counted[["o", "t"]].to_numpy())
    rest = few.where(F.col("pick") % FOLD == 0).select(F.col("toxic").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in blocks(lowered(batches)):
            f = scorer.features(b.data, b.off)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(4))], names=["y", *FEATURES])

    seen = rest.mapInArrow(run, "y long, " + ", ".join(f"{c} double" for c in FEATURES)).orderBy("y", *FEATURES).toPandas()
    if seen["y"].nunique() < 2:
        return model, np.array([0.0, 1.0, 0.0, 0.0, 0.0])
    return model, _logistic(seen[FEATURES].to_numpy(), seen["y"].to_numpy(np.float64))


def score(docs: DataFrame, labels: DataFrame, test_mod: int = 4, test_rest: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels (doc_id, toxic) of held-out ids aren't read."""
    known = labels.where((crc_mod("doc_id", test_mod) != test_rest) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit(docs.select("doc_id", "text"), known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(model, float) else Scorer(model[0])
        for b in blocks(lowered(batches)):
            if scorer is None:
                p = np.full(len(b.ids), model)
            else:
                z = model[1][0] + scorer.features(b.data, b.off) @ model[1][1:]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            held = b.remainders(test_mod) == test_rest
            yield pa.RecordBatch.from_arrays([b.id_column(), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
