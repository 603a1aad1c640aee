"""Language identification by rank-order profiles.

A profile is the PROFILE most frequent character n-grams (n = 1 to 3, words of letters
between boundaries) in order of frequency. A text goes to the language whose profile is
nearest by out-of-place distance: the sum, over the text's own most frequent n-grams, of
how far each one's rank is from its rank in the profile, PROFILE for those it lacks. The
score is 1 minus the distance as a share of the greatest possible.

Profiles count every n-gram of every training document: tasks add up their own, so only
distinct n-grams are shuffled. They are small by construction (PROFILE rows a language)
and go to the executors. Prediction is one scan without a shuffle.

Ties in frequency go by the n-gram's code points, in profiles and texts alike, ties between
languages by name. Defined cases: null text or text without a letter is `und` with score 0; so
is everything if nothing can be learned; null lang isn't learned from; a text of any length is
counted whole; repeated rows count and are judged each; a null doc_id counts as the empty text
where documents are split and is returned as null; an empty table gives an empty result; columns
other than doc_id, text and lang, of any name, are ignored. Profiles go to every executor, so
more than MAX_LANGS languages are an error (ValueError) and not cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packed import Block, ascending, blocks
from .shared import crc_mod

PROFILE, MAX_LANGS, SIZES = 400, 5_000, 3
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


class Grams:
    """A block's n-grams as numbers in the order of their code points.

    Symbols are numbered from 1 by code point, 1 is a word's boundary, and 0 stands where a gram has ended.
    """

    def __init__(self, block: Block):
        raw = block.data.tobytes()
        texts = [raw[i:j].decode().lower() for i, j in zip(block.off[:-1].tolist(), block.off[1:].tolist())]
        codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        codes = np.where(_letters()[codes], codes, 0)
        held = np.zeros(0x110000, bool)
        held[codes] = True
        held[0] = True
        self.number = np.cumsum(held)
        self.number[~held] = -1
        self.symbols = np.concatenate([[0], np.flatnonzero(held)])
        self.bits = int(len(self.symbols) - 1).bit_length()
        s = self.number[codes].astype(np.uint64)
        doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        doc = np.concatenate([doc, [len(texts) - 1]]) if len(texts) else np.zeros(1, np.int64)
        b = np.uint64(self.bits)
        one = np.flatnonzero(s[:-1] > 1)
        two = np.flatnonzero((s[:-1] > 1) | (s[1:] > 1))
        three = np.flatnonzero(s[1:-1] > 1)
        self.doc = np.concatenate([doc[np.maximum(one - 1, 0)], doc[np.where(s[two] > 1, two - 1, two)], doc[three]])
        self.gram = np.concatenate([s[one] << (b + b), (s[two] << (b + b)) | (s[two + 1] << b), (s[three] << (b + b)) | (s[three + 1] << b) | s[three + 2]])

    def counted(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (label of the document, gram) with counts, ascending."""
        of, shift = label[self.doc], np.uint64(3 * self.bits)
        if not len(of):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if 3 * self.bits + int(of.max()).bit_length() <= 64:
            key = np.sort((of.astype(np.uint64) << shift) | self.gram)
            which, gram = (key >> shift).astype(np.int64), key & ((np.uint64(1) << shift) - np.uint64(1))
        else:
            order = np.lexsort((self.gram, of))
            which, gram = of[order].astype(np.int64), self.gram[order]
        starts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (gram[1:] != gram[:-1])]))
        return which[starts], gram[starts], np.diff(np.append(starts, len(which)))

    def spell(self, gram: np.ndarray) -> list[str]:
        """Grams as text, boundaries as spaces."""
        mask = np.uint64((1 << self.bits) - 1)
        number = np.stack([((gram >> np.uint64(k * self.bits)) & mask).astype(np.int64) for k in (2, 1, 0)], 1)
        size = (number > 0).sum(1).tolist()
        chars = np.where(number == 1, 32, self.symbols[number])
        return ["".join(map(chr, r[:n])) for r, n in zip(chars.tolist(), size)]

    def find(self, texts: list[str]) -> np.ndarray:
        """The numbers of grams given as text; 0 for those with a symbol that isn't in this block."""
        out = np.zeros(len(texts), np.uint64)
        for k, t in enumerate(texts):
            symbols = [1 if c == " " else int(self.number[ord(c)]) for c in t]
            if min(symbols) > 0:
                v = 0
                for j, s in enumerate(symbols):
                    v |= s << ((SIZES - 1 - j) * self.bits)
                out[k] = v
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, gram) over a partition's documents."""
    total: dict[str, pd.Series] = {}

    def rows(some: dict[str, pd.Series]) -> pa.RecordBatch:
        langs = [x for x, s in some.items() for _ in range(len(s))]
        names = [g for s in some.values() for g in s.index]
        counts = np.concatenate([s.to_numpy(np.int64) for s in some.values()]) if some else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        at = 0
        for b in blocks([batch]):
            own = langs[at : at + len(b.ids)]
            at += len(b.ids)
            names, label = np.unique(own.astype(str), return_inverse=True)
            g = Grams(b)
            which, gram, n = g.counted(label)
            known = ascending(gram)
            text = pd.Index(g.spell(known))[np.searchsorted(known, gram)]
            for k, name in enumerate(names):
                use = which == k
                s = pd.Series(n[use], index=text[use])
                total[name] = total[name].add(s, fill_value=0) if name in total else s
            if sum(map(len, total.values())) > 500_000:
                yield rows(total)
                total = {}
    yield rows(total)


def learn(labelled: DataFrame) -> dict[str, list[str]]:
    """Profiles by language: n-grams in order of frequency. labelled: doc_id, text, lang."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE)
    found = top.select("lang", "gram", "rank").limit(MAX_LANGS * PROFILE + 1).toPandas()
    if len(found) > MAX_LANGS * PROFILE:
        raise ValueError(f"over {MAX_LANGS} languages")
    found = found.sort_values(["lang", "rank"])
    return {lang: part["gram"].tolist() for lang, part in found.groupby("lang", sort=True)}


def nearest(block: Block, profiles: dict[str, list[str]]) -> tuple[list[str], np.ndarray]:
    """The language and score of each document of a block."""
    g, n = Grams(block), len(block.ids)
    doc, gram, count = g.counted(np.arange(n))
    order = np.argsort((doc << 32) - count, kind="stable")
    doc, gram = doc[order], gram[order]
    first = np.searchsorted(doc, np.arange(n))
    rank = np.arange(len(doc)) - first[doc]
    use = rank < PROFILE
    doc, gram, rank = doc[use], gram[use], rank[use]
    size = np.bincount(doc, minlength=n)
    distance = np.full((len(profiles), n), np.inf)
    for k, profile in enumerate(profiles.values()):
        known = g.find(profile)
        place = np.argsort(known)
        at = np.minimum(np.searchsorted(known[place], gram), len(known) - 1)
        out = np.where(known[place][at] == gram, np.abs(place[at] - rank), PROFILE)
        distance[k] = np.bincount(doc, out, n)
    names = np.array([*profiles, "und"], object)
    if not profiles:
        return ["und"] * n, np.zeros(n)
    best = np.where(size > 0, distance.argmin(0), len(profiles))
    return names[best].tolist(), np.where(size > 0, 1 - distance.min(0) / np.maximum(size * PROFILE, 1), 0.0)


def predict(docs: DataFrame, profiles: dict[str, list[str]], test_mod: int = 5, test_rest: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            lang, score = nearest(b, profiles)
            held = b.remainders(test_mod) == test_rest
            yield pa.RecordBatch.from_arrays([b.id_column(), pa.array(held, pa.bool_()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def identify(docs: DataFrame, test_mod: int = 5, test_rest: int = 0) -> DataFrame:
    """Profiles from documents that aren't held out; then predict all."""
    return predict(docs, learn(docs.where(crc_mod("doc_id", test_mod) != test_rest)), test_mod, test_rest)


#: `identify` over a table `documents` with non-null doc_ids, in DuckDB's dialect. Its lower() and letters are those of Unicode's simple rules.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, concat(' ', trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')), ' ') AS t,
xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 = 0 AS held_out FROM documents),
c AS (SELECT rid, c, lead(c, 1, '') OVER w AS c2, lead(c, 2, '') OVER w AS c3 FROM (SELECT rid, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM d WHERE t <> '  ') WINDOW w AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, g, count(*) AS n FROM (SELECT rid, c AS g FROM c WHERE c <> ' ' UNION ALL SELECT rid, c || c2 FROM c WHERE c2 <> '' UNION ALL SELECT rid, c || c2 || c3 FROM c WHERE c3 <> '' AND c2 <> ' ') GROUP BY 1, 2),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS place FROM g JOIN d USING (rid) WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2 QUALIFY place < {PROFILE}),
own AS (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, g) - 1 AS rank FROM g QUALIFY rank < {PROFILE}),
far AS (SELECT rid, l.lang, sum(CASE WHEN place IS NULL THEN {PROFILE} ELSE abs(place - rank) END) AS distance, count(*) AS size FROM own CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = own.g GROUP BY 1, 2),
best AS (SELECT rid, lang, 1 - distance::DOUBLE / (size * {PROFILE}) AS score FROM far QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN best USING (rid)"""
