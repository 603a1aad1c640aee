"""SimHash fingerprints and their near-duplicate classes.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
text's 3-word shingles. Texts link where fingerprints differ in 2 bits at most.

Byte-position inverted index with count filtering: two fingerprints that differ in 2 bits
share at least 6 of their 8 (position, byte) entries. A list of one entry alone holds 1/256
of everything, so the index posts under four entries at a time: positions come in four groups
of two, at most two bytes differ, hence any two linked fingerprints agree on at least two
groups and meet in one of six lists. Within a list the members' shared entries are tallied pair
by pair, pairs below 6 dropped and the rest verified bit by bit. Lists over LIST members are
split first by two further entries, in each of the six ways that 6 shared entries allow; then
members agree on six bytes and are distinct, so there are at most 2^16 of them, however many
copies there are, and above PAIRWISE members a pair with the least tally is found by looking
up each member with one or two of its last sixteen bits turned. What leaves a list is a
spanning forest of its links, never all pairs. Components over all lists come from rounds of
large-star and small-star steps, each cut in shared storage.

Exact copies and equal fingerprints collapse before the index, so a group of copies with a
third of all rows is one entry.

Defined cases: null and empty text have fingerprint zero, linked like any other; fewer than
three words make one shingle; a text of any length is hashed whole; null doc_ids are returned,
and count as larger than all others (a component of null ids only has a null component_id);
repeated rows are returned each by `classes`, and `keep_one` keeps one of them; among rows with
the least id of a component it keeps the one with the least fingerprint, then the least hash of
its text, then of its other columns; an empty table gives an empty result; other columns, of any
name, are ignored by `classes` and come back unchanged from `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packed import blocks_with_rows
from .shared import cut

SHINGLE, SEED, BITS, BYTES = 3, 42, 2, 8
LEAST = BYTES - BITS
#: The four positions of each of the six kinds of lists; for each of them, the six ways to add two more.
PAIRS_OF_GROUPS = [tuple(p for g in two for p in (2 * g, 2 * g + 1)) for two in combinations(range(4), 2)]
FURTHER = [list(combinations([p for p in range(BYTES) if p not in four], 2)) for four in PAIRS_OF_GROUPS]
#: Lists over LIST members are split by two more bytes; up to PAIRWISE members pairs are tallied, CHUNK members against all at a time.
LIST, PAIRWISE, CHUNK = 1024, 2048, 64


def fingerprint_hashes(text: bytes) -> list[int]:
    """XXH64 of each shingle; text: UTF-8, any case."""
    words = text.lower().split()  # of bytes: A-Z, and blanks \x20 \x09-\x0D
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    h = xxhash.xxh64_intdigest
    return [h(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        hashes = fingerprint_hashes(text)
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
            most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
            out[k] = np.packbits(most, bitorder="little").view("<u8")[0]
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, rows in blocks_with_rows(batches):
        raw = b.data.tobytes()
        fp = fingerprints_of([raw[i:j] for i, j in zip(b.off[:-1].tolist(), b.off[1:].tolist())])
        yield pa.RecordBatch.from_arrays([b.id_column(), pa.array(fp.view(np.int64)), rows.column("pick").combine_chunks()], names=["doc_id", "fp", "pick"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and pick (a hash of the text)."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("pick")).mapInArrow(_fingerprint, "doc_id long, fp long, pick long")


def forest(fp: np.ndarray, shared: tuple[int, ...]) -> list[tuple[int, int]]:
    """Links (member, least member of its class) among distinct fingerprints that agree on the bytes at `shared`."""
    n = len(fp)
    root = np.arange(n)
    if n <= PAIRWISE or len(shared) < LEAST:
        entry = fp.view(np.uint8).reshape(n, BYTES)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, n, CHUNK):
            tally = np.full((min(CHUNK, n - at), n), len(shared), np.uint8)
            for k in range(BYTES):
                if k not in shared:
                    tally += entry[at : at + CHUNK, None, k] == entry[None, :, k]
            i, j = np.nonzero(tally >= LEAST)
            near = np.bitwise_count(fp[at + i] ^ fp[j]) <= BITS
            a.append(at + i[near])
            b.append(j[near])
        a, b = np.concatenate(a), np.concatenate(b)
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            if (low == root).all():
                break
            root = low
    else:
        rest = np.zeros(n, np.int64)
        for j, k in enumerate(k for k in range(BYTES) if k not in shared):
            rest |= ((fp >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) << (8 * j)
        width = 8 * (BYTES - len(shared))
        held = np.full(1 << width, n)
        masks = [1 << i for i in range(width)] + [(1 << i) | (1 << j) for i, j in combinations(range(width), 2)]
        while True:
            held[rest] = root
            low = root.copy()
            for m in masks:
                np.minimum(low, held[rest ^ m], out=low)
            if (low == root).all():
                break
            root = low
    moved = np.flatnonzero(root != np.arange(n))
    return list(zip(fp[moved].view(np.int64).tolist(), fp[root[moved]].view(np.int64).tolist()))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links: set[tuple[int, int]] = set()
        for which, more, members in zip(batch.column("which").to_pylist(), batch.column("more").to_pylist(), batch.column("members").to_pylist()):
            shared = PAIRS_OF_GROUPS[which] + (FURTHER[which][more] if more is not None else ())
            links.update(forest(np.sort(np.array(members, np.int64).view(np.uint64)), shared))
        a, b = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _entries(fp: str, positions: tuple[int, ...]) -> Column:
    """The bytes of fp at some positions as one number."""
    value = F.lit(0).cast("long")
    for j, k in enumerate(positions):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)), 8 * j))
    return value


def links(distinct: DataFrame, most: int = LIST) -> DataFrame:
    """Edges (a, b) that connect what links among distinct fingerprints (column fp)."""
    post = [F.struct(F.lit(w).alias("which"), _entries("fp", four).alias("entry")) for w, four in enumerate(PAIRS_OF_GROUPS)]
    posted = distinct.select("fp", F.explode(F.array(*post)).alias("p")).select("fp", "p.which", "p.entry")
    met = cut(posted.withColumn("n", F.count("*").over(Window.partitionBy("which", "entry"))).where("n > 1"), "posted")
    small = met.where(F.col("n") <= most).groupBy("which", F.lit(None).cast("int").alias("more"), "entry").agg(F.collect_list("fp").alias("members"))
    again = F.when(F.lit(False), F.array().cast("array<struct<more:int,further:long>>"))
    for w, ways in enumerate(FURTHER):
        again = again.when(F.col("which") == w, F.array(*[F.struct(F.lit(m).alias("more"), _entries("fp", two).alias("further")) for m, two in enumerate(ways)]))
    large = met.where(F.col("n") > most).select("which", "entry", "fp", F.explode(again).alias("p")).groupBy("which", "p.more", "entry", "p.further").agg(F.collect_list("fp").alias("members"))
    lists = small.select("which", "more", "members").unionAll(large.where(F.size("members") > 1).select("which", "more", "members"))
    return lists.mapInArrow(_link, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is its component's least node. Large-star, small-star rounds."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    sign, was = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first(), None
    while (state := sign(now)) != was:
        was = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _rooted(held: DataFrame) -> DataFrame:
    """fp, root, component_id of each distinct fingerprint of held (doc_id, fp)."""
    distinct = cut(held.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fp")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    held = cut(fingerprints(docs), "fingerprints")
    return held.join(_rooted(held), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the least doc_id, unchanged.

    Fingerprints are worked out once; texts are shuffled once, to meet the rows chosen.
    """
    held = cut(fingerprints(docs), "fingerprints")
    stay = held.join(_rooted(held), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "pick")).alias("x"))
    key = [F.col("k.none").alias("none"), F.coalesce("k.doc_id", F.lit(0)).alias("id"), F.col("k.pick").alias("pick")]
    stay = stay.select(F.col("x").alias("k")).select(*key)
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("pick")).alias("k"), F.xxhash64(*plain).alias("whole"))
    rows = rows.select("row", *key, "whole").join(stay, ["none", "id", "pick"], "left_semi")
    return rows.groupBy("none", "id", "pick").agg(F.min_by("row", "whole").alias("row")).select("row.*")
