"""Best-fit packing of tokenised documents into sequences of fixed length.

Hierarchical residual packing: each partition packs its pieces best-fit (longest first,
into the open bin that they fill most) in slices of at most SLICE pieces. Full bins are done;
bins with room, even for one id, go up as items of their own length. The slices of a partition,
then FAN groups at a time, merge: the items of a group are packed best-fit again, until one
group is left.

A merge needs to know only how many items of each length every child has, at most CAPACITY
numbers a child, and its outcome is a list of runs: items a to b of length n of a child take
places in bins c to d. Runs split as little as counts do, so there are a few thousand a group
however many items there are, all underfull bins take part at every level, and nothing is
capped. An item's number in its child says which run moves it; numbers come from arithmetic,
never from a sort of a whole group.

Token ids are those of the tokenizer file. A byte-level BPE file whose ids are in merge
order (checked on loading) is run by a faster library with ids equal by construction; any
other file, and texts that hold a special token's string, go through `tokenizers` itself.

Defined cases: null and empty text are the closing id alone; a text of any length is encoded
whole and cut into pieces; pieces of equal length are interchangeable, and go in row order; a null
doc_id is packed and returned as null; repeated rows are packed each; an empty table gives an empty
result; columns other than doc_id and text, of any name, are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

CAPACITY, CLOSE, FAN, SLICE = 2048, 0, 16, 1 << 16
#: Bits of a slice's number in its partition and of a bin's in its slice; 2**30 partitions fit beside them.
SLICE_BITS, BIN_BITS = 16, 17
#: Groups at a level up to which its runs are broadcast: each has at most FAN * CAPACITY runs and some thousands more.
BROADCAST_GROUPS = 4
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: child: the slice; rank: the number of the bin among its child's of that fill.
PLACED = PIECE + ", bin long, at long, fill int, child long, rank long"
#: Of items of length fill, those numbered lo to hi - 1 in their child: item r is copy (r + delta) % each of bin (r + delta) // each.
RUN = "child long, fill int, lo long, hi long, delta long, each int, shift int, new_fill int, new_rank long, parent long"
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts under a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        """The same encoding by tiktoken where the file is plain byte-level BPE in merge order, else None."""
        model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True):
            return None
        import tiktoken

        # the printable stand-ins of byte-level files: visible Latin-1 stands for itself, the rest from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if ids != sorted(ids) or len(set(ids)) + 256 != len(ranks) or (ids and ids[0] < 256):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole if it fits, else the remainder first, then full pieces."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, n, capacity)]


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([CLOSE], "<u4")).astype("<u4", copy=False)
                for k, (s, n) in enumerate(pieces_of(len(ids))):
                    rows.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            yield _batch(rows, PIECE)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, place of each item in it, fill of each bin), longest items first."""
    bins, places, fills = [0] * len(lengths), [0] * len(lengths), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: a bin with room r is open
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, k = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = k, fills[k]
        fills[k] += n
        left = room - n
        if left:
            open_bins[left].append(k)
            rooms |= 1 << left
    return bins, places, fills


def best_fit_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """best_fit of counts[n] items of each length n: (number of bins, [(length, first item, items a bin)] in place order).

    Bin i of an entry holds, of each of its lengths, the items first + i * each to first + (i + 1) * each - 1.
    """
    bins: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}  # by room
    rooms = 0

    def add(room: int, n: int, parts: list[tuple[int, int, int]]) -> None:
        nonlocal rooms
        if n:
            bins.setdefault(room, []).append((n, parts))
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        while left:
            fitting = rooms >> length
            if not fitting:
                each = capacity // length
                add(capacity - each * length, left // each, [(length, first, each)])
                add(capacity - left % each * length, int(left % each > 0), [(length, first + left // each * each, left % each)])
                break
            room = length + (fitting & -fitting).bit_length() - 1
            n, parts = bins[room].pop()
            if not bins[room]:
                rooms ^= 1 << room
            # a bin takes as many as fit before a roomier one is opened
            each = min(room // length, left)
            some = min(n, left // each)
            add(room - each * length, some, [*parts, (length, first, each)])
            add(room, n - some, [(k, f + some * e, e) for k, f, e in parts])
            left, first = left - some * each, first + some * each
    return [entry for room in sorted(bins) for entry in bins[room]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best fit within slices of a partition."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE)
            bins, places, fills = best_fit(rows.column("length").to_pylist())
            child = (part << SLICE_BITS) + number
            seen: dict[int, int] = {}
            rank = []
            for f in fills:
                rank.append(seen.get(f, 0))
                seen[f] = rank[-1] + 1
            bins_, fills_, rank_ = np.array(bins, np.int64), np.array(fills, np.int64), np.array(rank, np.int64)
            more = [pa.array((child << BIN_BITS) + bins_), pa.array(places, pa.int64()), pa.array(fills_[bins_].astype(np.int32)), pa.array(np.full(len(bins), child)), pa.array(rank_[bins_])]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[f.split()[0] for f in PLACED.split(", ")])
            number += 1


def runs_of(parent: int, counts: dict[int, dict[int, int]], capacity: int = CAPACITY) -> list[tuple]:
    """Rows of RUN for one group; counts: items by child and length."""
    total: dict[int, int] = {}
    spans: dict[int, list[tuple[int, int, int]]] = {}  # by length: (child, from, to) among the group's items
    for child in sorted(counts):
        for n, c in sorted(counts[child].items()):
            spans.setdefault(n, []).append((child, total.get(n, 0), total.get(n, 0) + c))
            total[n] = total.get(n, 0) + c
    made: dict[int, int] = {}
    moves: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
    for n, parts in best_fit_counts(total, capacity):
        fill = sum(length * each for length, _, each in parts)
        at = 0
        for length, first, each in parts:
            moves.setdefault(length, []).append((first, first + n * each, each, at, fill, made.get(fill, 0)))
            at += length * each
        made[fill] = made.get(fill, 0) + n
    out = []
    for length, ranges in moves.items():
        ranges.sort()
        own, k = spans[length], 0
        for first, last, each, at, fill, base in ranges:
            while k and own[k - 1][2] > first:
                k -= 1
            while k < len(own) and own[k][1] < last:
                child, lo, hi = own[k]
                if hi > first:
                    out.append((child, length, max(lo, first) - lo, min(hi, last) - lo, lo - first, each, at, fill, base, parent))
                k += 1
    return out


def _merge(table: pa.Table) -> pa.Table:
    counts: dict[int, dict[int, int]] = {}
    for child, fill, n in zip(table.column("child").to_pylist(), table.column("fill").to_pylist(), table.column("n").to_pylist()):
        counts.setdefault(child, {})[fill] = n
    return pa.Table.from_batches([_batch(runs_of(table.column("parent")[0].as_py(), counts), RUN)])


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    pieces = cut(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer), PIECE), "pieces")
    placed = cut(pieces.mapInArrow(_local, PLACED), "placed")
    under = placed.where((F.col("at") == 0) & (F.col("fill") < CAPACITY))  # a row per bin
    moved = under.select("bin", F.col("child").alias("group"), "fill", "rank", F.lit(0).cast("long").alias("shift"))
    hist = cut(under.groupBy("child", "fill").agg(F.count("*").alias("n")), "fills")
    size, level = (hist.agg(F.max(F.shiftright("child", SLICE_BITS))).first()[0] or 0) + 1, 0
    up = F.shiftright("child", SLICE_BITS)  # first the slices of each partition, then FAN groups at a time
    while True:
        runs = cut(hist.withColumn("parent", up).groupBy("parent").applyInArrow(_merge, RUN), f"runs-{level}")
        small = F.broadcast(runs) if size <= BROADCAST_GROUPS else runs
        same = (moved["group"] == small["child"]) & (moved["fill"] == small["fill"]) & (moved["rank"] >= small["lo"]) & (moved["rank"] < small["hi"])
        place = moved["rank"] + small["delta"]
        moved = moved.join(small, same).select(
            "bin",
            F.col("parent").alias("group"),
            F.col("new_fill").alias("fill"),
            (F.col("new_rank") + F.floor(place / F.col("each"))).cast("long").alias("rank"),
            (moved["shift"] + small["shift"] + (place % F.col("each")) * moved["fill"]).cast("long").alias("shift"),
        )
        if size == 1:
            break
        moved = cut(moved, f"moved-{level}")
        # a bin's first item is the one that opens it: every run with shift 0 starts as many bins as it has first copies
        hist = cut(_filled(runs), f"fills-{level}")
        size, level, up = -(-size // FAN), level + 1, F.floor(F.col("child") / FAN).cast("long")
    end = moved.select(F.col("bin").alias("moved_bin"), (F.lit(1 << 62) + F.shiftleft(F.col("fill").cast("long"), 48) + F.col("rank")).alias("end"), "shift")
    out = placed.join(end, placed["bin"] == end["moved_bin"], "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("end", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _filled(runs: DataFrame) -> DataFrame:
    """child, fill, n: how many bins of each fill a level's groups have now."""
    first = F.floor((F.col("lo") + F.col("delta") + F.col("each") - 1) / F.col("each"))
    last = F.floor((F.col("hi") + F.col("delta") - 1) / F.col("each"))
    started = runs.where("shift = 0").select(F.col("parent").alias("child"), F.col("new_fill").alias("fill"), (last - first + 1).cast("long").alias("n"))
    return started.groupBy("child", "fill").agg(F.sum("n").alias("n"))
