"""Language-model scores by deleted interpolation.

P(w | u, v) = l3(b) c(u,v,w)/c(u,v) + l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b) / (V + 1), where
u and v are the two words before w (or the start of the text) and b is the bucket of the
context's frequency: the power of two of c(u,v) where that context is known, else that of
c(v). One end token closes each text. Counts come from all training documents.

The weights of each bucket are learned by expectation-maximisation on held-out counts:
each block of documents is cut into FOLDS parts; for the tokens of a part the counts that
this part itself added are deleted from the corpus totals, and what is left predicts them.
The events are tallied by bucket and the three deleted estimates on a logarithmic grid, which
bounds what the driver sees by BUCKETS * GRID ** 3 cells whatever the input (real corpora fill
a small share); scores use exact counts.

Rows per n-gram would make the shuffle many times the input. Instead blocks of documents
ask buckets for the totals of their distinct n-grams in packed, sorted, delta-coded form
(see packed.py): one entry for each block that holds a key, so a hot word is one number per
block. Words are held as 64-bit hashes.

Defined cases: null text is empty (one end token); a null doc_id counts as an id with empty
text and is returned as null; a text of any length is one row of a block and scored whole;
repeated rows count and are scored once each; ties don't arise; an empty table gives an empty
result; with no training document every probability is that of the uniform part; columns
other than doc_id and text, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import DOCS, LOWER, PACKET, SPACES, U64, Block, Route, Totals, blocks, hash_spans, mix, packets, resolve, send_docs, spans, sum_by_key
from .shared import stable, text_size

WORDS, PAIRS, TRIPLES, STATS = 10, 11, 12, 13
START, END = U64(0x51ED270B7A1F3C69), U64(0x2545F4914F6CDD1D)
#: Buckets of known pair contexts, then as many of word contexts; cells of the grid, two to a power of two.
HALF, GRID, STEPS, FOLDS = 24, 64, 2, 4
BUCKETS = 2 * HALF
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Tokens:
    """Of a block: token hashes, those of the word before and of the one before that, where each document's tokens begin, whose they are, which documents train."""

    token: np.ndarray
    before: np.ndarray
    earlier: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    train: np.ndarray


def tokens_of(block: Block, test_mod: int, test_rest: int) -> Tokens:
    starts, ends = spans(block.data, block.off, SPACES)
    n, doc = len(block.ids), block.doc_of(starts)
    token = np.full(len(starts) + n, END)
    token[np.arange(len(starts)) + doc] = hash_spans(block.data, starts, ends, LOWER)
    size = np.bincount(doc, minlength=n) + 1
    begin = np.cumsum(size) - size
    before = np.concatenate([[START], token[:-1]])
    before[begin] = START
    earlier = np.concatenate([[START], before[:-1]])
    earlier[begin] = START
    return Tokens(token, before, earlier, begin, np.repeat(np.arange(n), size), block.remainders(test_mod) != test_rest)


def _follow(h: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(h * U64(0x9E3779B97F4A7C15) + token)


def keyed(t: Tokens) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct keys, training counts, number of each token's key) of words, word pairs and triples.

    The start symbol is a word key too, after the tokens: its count is the number of training documents.
    """
    trained = t.train[t.doc].astype(np.int64)
    words = sum_by_key(np.append(t.token, START), np.append(trained, int(t.train.sum())))
    return [words, sum_by_key(_follow(t.before, t.token), trained), sum_by_key(_follow(_follow(t.earlier, t.before), t.token), trained)]


class Words(Totals):
    """Totals of words; a bucket also says how many tokens and distinct words it holds."""

    def __init__(self):
        super().__init__(WORDS)

    def extra(self, cols):
        keys, total = cols
        word = keys != START
        return [(0, int(keys[0] >> U64(1)), STATS, np.array([total[word].sum(), (total[word] > 0).sum()], np.int64).tobytes(), b"")]


FOLDED = (Words(), Totals(PAIRS), Totals(TRIPLES))


def _ask(route: Route, mod: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            asked: list = []
            name = b.name
            for fold, (keys, counts, _) in zip(FOLDED, keyed(tokens_of(b, mod, rest))):
                route.send(fold, name, 1, (keys, counts), asked)
            yield packets(asked)

    return run


@dataclass
class Counts:
    """Of a block: corpus totals by key number of each order, and per token the key numbers of the token's grams and of its contexts."""

    totals: list[np.ndarray]
    word: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    before: np.ndarray
    #: Key numbers of the two words before as a pair; where the text begins, the start symbol's as a word.
    context: np.ndarray
    first: np.ndarray

    def of_context(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        return np.where(self.first, words[self.before], pairs[self.context])


def counts_of(rows: list[dict], t: Tokens) -> Counts:
    keys = keyed(t)
    totals = [fold.answers(rows, len(k[0]))[0].astype(np.int64) for fold, k in zip(FOLDED, keys)]
    word, start = keys[0][2][:-1], keys[0][2][-1]
    before = np.concatenate([[start], word[:-1]])
    before[t.begin] = start
    first = np.zeros(len(word), bool)
    first[t.begin] = True
    return Counts(totals, word, keys[1][2], keys[2][2], before, np.concatenate([[0], keys[1][2][:-1]]), first)


def _bucket(cuv: np.ndarray, cv: np.ndarray) -> np.ndarray:
    power = lambda c: np.minimum(np.frexp(c.astype(np.float64))[1], HALF - 1)
    return np.where(cuv > 0, power(cuv), HALF + power(cv))


def _grid(p: np.ndarray) -> np.ndarray:
    """0 for 0, else a cell of the logarithm, 1 for probability 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-STEPS * np.log2(p)) + 1, 1, GRID - 1), 0).astype(np.int64)


def _events(total: int, mod: int, rest: int):
    """Held-out events of a block, tallied on the grid."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        cells: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for d in (r for r in rows if r["kind"] == DOCS):
            t = tokens_of(Block.unpack(d["a"], d["b"]), mod, rest)
            c = counts_of(rows, t)
            for part in range(FOLDS):
                docs = t.train & (np.arange(len(t.train)) % FOLDS == part)
                held = docs[t.doc]
                # what is left of each total without what this part added; a context's own tokens are those that follow it
                left = [all_ - np.bincount(number[held], minlength=len(all_)) for all_, number in zip(c.totals, (c.word, c.pair, c.triple))]
                words = c.totals[0] - np.bincount(c.before[held], minlength=len(c.totals[0]))
                pairs = c.totals[1] - np.bincount(c.context[held & ~c.first], minlength=len(c.totals[1]))
                cuv, cv = c.of_context(words, pairs)[held], words[c.before[held]]
                f3, f2 = left[2][c.triple[held]] / np.maximum(cuv, 1), left[1][c.pair[held]] / np.maximum(cv, 1)
                f1 = left[0][c.word[held]] / max(1, total - int(held.sum()))
                cell, n = np.unique(((_bucket(cuv, cv) * GRID + _grid(f3)) * GRID + _grid(f2)) * GRID + _grid(f1), return_counts=True)
                cells.append(cell)
                counts.append(n)
        cell = np.concatenate(cells) if cells else np.zeros(0, np.int64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def learn_weights(cells: np.ndarray, counts: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, [triple, pair, word, uniform]) by expectation-maximisation on tallied held-out events.

    Buckets without events take the weights of the nearest lower one that has some; the first, all uniform.
    """
    rep = lambda g: np.where(g > 0, 2.0 ** (-(g - 1.0) / STEPS), 0.0)
    b, f3, f2, f1 = cells // GRID**3, rep(cells // GRID**2 % GRID), rep(cells // GRID % GRID), rep(cells % GRID)
    p = np.stack([f3, f2, f1, np.full(len(cells), 1.0 / (vocabulary + 1))], 1)
    weights = np.tile(np.array([0.0, 0.0, 0.0, 1.0]), (BUCKETS, 1))
    for k in range(BUCKETS):
        own = b == k
        if not own.any():
            weights[k] = weights[k - 1] if k else weights[k]
            continue
        w, n, q = np.full(4, 1 / 4), counts[own][:, None].astype(np.float64), p[own]
        for _ in range(rounds):
            share = q * w
            w = (n * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
        w = np.maximum(w, 1e-6)  # an unseen token keeps a probability
        weights[k] = w / w.sum()
    return weights


def _score(total: int, vocabulary: int, weights: np.ndarray, mod: int, rest: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for d in (r for r in rows if r["kind"] == DOCS):
            block = Block.unpack(d["a"], d["b"])
            t = tokens_of(block, mod, rest)
            c = counts_of(rows, t)
            words, pairs, triples = c.totals
            c1, cv, cuv = words[c.word], words[c.before], c.of_context(words, pairs)
            w = weights[_bucket(cuv, cv)]
            p = w[:, 0] * triples[c.triple] / np.maximum(cuv, 1) + w[:, 1] * pairs[c.pair] / np.maximum(cv, 1) + w[:, 2] * c1 / max(1, total) + w[:, 3] / (vocabulary + 1)
            base = np.log10((c1 + 1) / (total + vocabulary + 1))
            size = np.diff(np.append(t.begin, len(t.token)))
            cols = [
                block.id_column(),
                pa.array(~t.train),
                pa.array(size.astype(np.int64)),
                pa.array(np.add.reduceat((c1 > 0).astype(np.int64), t.begin)),
                pa.array(np.full(len(size), total, np.int64)),
                pa.array(np.add.reduceat(base, t.begin)),
                pa.array(np.add.reduceat(np.log10(p), t.begin)),
            ]
            out.append(pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")]))
        if not out:
            raise RuntimeError("answers came for a block that wasn't sent: the input was read in another order")
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame, test_mod: int = 7, test_rest: int = 2, route: Route | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Documents whose crc32(doc_id as text) mod test_mod is test_rest are held out; the others train.
    """
    rows = stable(docs.select("doc_id", "text"), "lm-docs")
    route = route or Route.for_size(text_size(rows))
    answers = resolve(rows.mapInArrow(_ask(route, test_mod, test_rest), PACKET), list(FOLDED), route, "lm-totals")
    sums = answers.where(F.col("kind") == STATS).select("a").mapInArrow(_stats, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    total, vocabulary = sums[0] or 0, sums[1] or 0
    met = rows.mapInArrow(send_docs, PACKET).unionAll(answers.where(F.col("kind") != STATS)).groupBy("dst")
    cells = met.applyInArrow(_events(total, test_mod, test_rest), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), vocabulary)
    return met.applyInArrow(_score(total, vocabulary, weights, test_mod, test_rest), RESULT)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = np.frombuffer(b"".join(b.column("a").to_pylist()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["tokens", "words"])
