"""Blocks of documents as numpy arrays, and packets that carry sorted keys between blocks and buckets.

A block is a few megabytes of neighbouring rows of one partition; where blocks begin depends
on the order and the texts of the rows alone, not on how they are batched, so two scans with
different columns have equal blocks. Operators that need corpus-wide facts about very many
small keys (n-grams, anchors) don't make a row per key: each block sends its distinct keys
to buckets, packed as sorted, delta-coded binary, and each bucket answers in the order asked.
Pre-aggregation within the block makes a hot key one entry per block. A block is named by a
hash of its content, so a re-run of a lost task names it alike, and identical blocks simply
share their answers.

An exchange is linear in its input: a block sends at most `fan` packets of a kind, whatever
the number of buckets. Where more buckets than that are needed, packets of one key range from
a group of blocks meet at a node, which merges their keys and asks `fan` narrower ranges in
turn; answers come back the same way. Nodes of every level are as many as buckets, and each
hop costs two tables and three shuffles of the keys, while a wider fan only costs smaller
packets: so the fan widens with the input before there is a second hop (see Route).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .shared import cut, drop, shuffles_removed

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 16
PACKET = "dst long, src long, kind int, a binary, b binary"
SCHEMA = pa.schema([("dst", pa.int64()), ("src", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
#: Kinds of packets that every exchange knows; operators number theirs from 10.
DOCS, ROWS = 0, 1
#: Fills the place of a null id; which ids are null is always held beside.
NO_ID = np.int64(2**63 - 1)
U64 = np.uint64
#: Kinds of answers are those of what was asked, and this.
ANSWER = 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@dataclass
class Block:
    """ids: doc ids; none: which are null; data: UTF-8 bytes of all texts; off: where each begins, and the end."""

    ids: np.ndarray
    none: np.ndarray
    data: np.ndarray
    off: np.ndarray

    @property
    def name(self) -> int:
        h = xxhash.xxh3_64(self.ids.tobytes())
        h.update(self.none.tobytes())
        h.update(self.off.tobytes())
        h.update(np.ascontiguousarray(self.data).data)
        return signed(h.intdigest())

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The document (index) that holds each byte position."""
        return np.searchsorted(self.off, at, "right") - 1

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.none)

    def remainders(self, mod: int) -> np.ndarray:
        """crc32 of each id as text, mod `mod`; a null id counts as the empty text."""
        return np.array([zlib.crc32(b"" if n else str(i).encode()) % mod for i, n in zip(self.ids.tolist(), self.none.tolist())], np.int64)

    def pack(self) -> tuple[bytes, bytes]:
        head = np.concatenate([[len(self.ids)], self.ids, self.none, self.off]).astype(np.int64).tobytes()
        return squeeze(head), zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(self.data).data)

    @staticmethod
    def unpack(a: bytes, b: bytes) -> Block:
        head = np.frombuffer(unsqueeze(a), np.int64)
        n = int(head[0])
        off = head[1 + 2 * n :]
        return Block(head[1 : 1 + n], head[1 + n : 1 + 2 * n].astype(bool), np.frombuffer(unsqueeze(b), np.uint8) if off[-1] else np.zeros(0, np.uint8), off)


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def unsqueeze(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack_ints(v: np.ndarray) -> bytes:
    """Integers with their byte planes apart, so that small ones take little room."""
    kind = v.dtype.str.encode().ljust(4)
    planes = np.ascontiguousarray(v).view(np.uint8).reshape(-1, v.dtype.itemsize).T
    return kind + squeeze(np.ascontiguousarray(planes).tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:4].strip().decode())
    planes = np.frombuffer(unsqueeze(b[4:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_ints(np.diff(keys, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(b), dtype=U64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def id_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which are null."""
    return pc.fill_null(column.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def blocks(batches: Iterable[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of batches with doc_id and text. A document is never split, so a block holds one at least."""
    for block, _ in blocks_with_rows(batches, most):
        yield block


def blocks_with_rows(batches: Iterable[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[Block, pa.Table]]:
    """Blocks, each with its rows as they came. A block ends before the row that would take it over `most` bytes."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]] = []
    size = rows = 0

    def joined_block() -> tuple[Block, pa.Table]:
        ids, none, data, lens, parts = zip(*held)
        block = Block(np.concatenate(ids), np.concatenate(none), np.concatenate(data), np.concatenate([[0], np.cumsum(np.concatenate(lens))]))
        return block, pa.Table.from_batches(parts)

    for batch in batches:
        ids, none = id_array(batch.column("doc_id"))
        data, off = text_bytes(batch.column("text"))
        at = 0
        while at < len(ids):
            to = min(int(np.searchsorted(off, off[at] + most - size, "right")) - 1, at + BLOCK_ROWS - rows, len(ids))
            if to <= at and held:
                yield joined_block()
                held, size, rows = [], 0, 0
                continue
            to = max(to, at + 1)
            held.append((ids[at:to], none[at:to], data[off[at] : off[to]], np.diff(off[at : to + 1]), batch.slice(at, to - at)))
            size, rows, at = size + int(off[to] - off[at]), rows + to - at, to
    if held:
        yield joined_block()


def packets(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA)], schema=SCHEMA)


def send_docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block as one packet to itself."""
    for b in blocks(batches):
        yield packets([(b.name, 0, DOCS, *b.pack())])


def send_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block as one packet to itself, and one with its rows' columns other than text."""
    for b, rows in blocks_with_rows(batches):
        rest = rows.drop_columns(["text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_table(rest)
        yield packets([(b.name, 0, DOCS, *b.pack()), (b.name, 0, ROWS, squeeze(sink.getvalue().to_pybytes()), b"")])


def rows_sent(packet: dict) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(packet["a"])).read_all()


def ascending(x: np.ndarray) -> np.ndarray:
    """The distinct values of x, ascending."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sum_by_key(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and for each entry the number of its key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(first) - 1
    return ordered[starts], np.add.reduceat(vals[order], starts) if len(keys) else vals, number


@dataclass(frozen=True)
class Route:
    """How an exchange is dealt: each hop splits a key range into 2**bits, the last hop ends at buckets."""

    hops: int
    bits: int = 7

    @staticmethod
    def for_size(size: int, share: int = 16 << 20, bits: int = 7, widest: int = 11) -> Route:
        """Buckets with a share of `size` bytes of text near `share` at most: 2**bits to 2**widest of them in one hop, as many as it takes in two beyond that."""
        need = ((max(size, 1) - 1) // share).bit_length()
        if need <= widest:
            return Route(1, max(bits, need))
        return Route(2, min(max(bits, (need + 1) // 2), widest))

    def send(self, fold: Fold, name: int, level: int, cols: tuple[np.ndarray, ...], out: list) -> None:
        """Adds packets by which `name` asks the nodes of a level about cols (cols[0]: ascending keys)."""
        if not len(cols[0]):
            return
        path = cols[0] >> U64(64 - self.bits * level)
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        group = int(mix(np.array([name & (2**64 - 1)], U64))[0]) % (1 << (self.bits * (self.hops - level)))
        for i, j, p in zip(starts.tolist(), [*starts[1:].tolist(), len(path)], path[starts].tolist()):
            out.append(((fold.kind << 57) | (level << 54) | (p << 24) | group, name, fold.kind, *fold.pack(tuple(c[i:j] for c in cols))))


class Fold:
    """What is asked about keys of one kind, how equal keys merge, and what is answered."""

    kind: int
    #: Numbers in each entry of an answer.
    width = 1

    def pack(self, cols: tuple[np.ndarray, ...]) -> tuple[bytes, bytes]:
        raise NotImplementedError

    def unpack(self, a: bytes, b: bytes) -> tuple[np.ndarray, ...]:
        raise NotImplementedError

    def merge(self, cols: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """Distinct entries ascending by key, and the number of each entry's."""
        raise NotImplementedError

    def solve(self, cols: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """One or two arrays with an answer to each distinct entry."""
        raise NotImplementedError

    def extra(self, cols: tuple[np.ndarray, ...]) -> list[tuple[int, int, int, bytes, bytes]]:
        """Further packets of a bucket."""
        return []

    def merged(self, rows: list[dict]):
        """(distinct entries, for each row the numbers of its own)."""
        parts = [self.unpack(r["a"], r["b"]) for r in rows]
        cols, number = self.merge(tuple(np.concatenate(c) for c in zip(*parts)))
        ends = np.cumsum([len(p[0]) for p in parts])
        return cols, [number[e - len(p[0]) : e] for p, e in zip(parts, ends.tolist())]

    def reply(self, row: dict, answer: tuple[np.ndarray, ...], own: np.ndarray) -> tuple[int, int, int, bytes, bytes]:
        a, b = (pack_ints(np.ascontiguousarray(x[own].T).ravel()) for x in (*answer, np.zeros(len(answer[0]), np.uint8))[:2])
        return row["src"], row["dst"], self.kind + ANSWER, a, b

    def answers(self, rows: list[dict], expect: int) -> tuple[np.ndarray, np.ndarray]:
        """The two arrays of answers to `expect` entries; identical blocks get each packet more than once."""
        by = {r["src"]: r for r in rows if r["kind"] == self.kind + ANSWER}
        parts = [[unpack_ints(by[k][c]) for k in sorted(by)] for c in "ab"]
        shaped = [np.concatenate([x.reshape(self.width, -1).T if self.width > 1 and x.size else x for x in p]) if p else np.zeros((0, self.width) if self.width > 1 else 0, np.int64) for p in parts]
        if len(shaped[0]) != expect:
            raise RuntimeError(f"asked for {expect} keys and got {len(shaped[0])} answers: the input was read in another order")
        return shaped[0], shaped[1]


class Totals(Fold):
    """(keys, what the asker adds to each): answers with totals."""

    def __init__(self, kind: int):
        self.kind = kind

    def pack(self, cols):
        keys, vals = cols
        small = vals.astype(np.uint32) if len(vals) and int(vals.max()) < 2**32 else vals.astype(np.uint64)
        return pack_sorted(keys), pack_ints(small)

    def unpack(self, a, b):
        return unpack_sorted(a), unpack_ints(b).astype(np.int64)

    def merge(self, cols):
        keys, sums, number = sum_by_key(*cols)
        return (keys, sums), number

    def solve(self, cols):
        total = cols[1]
        return (total.astype(np.uint32) if total.max() < 2**32 else total,)


class LeastId(Fold):
    """(one, two, none, ids): answers with the least id of each pair of hashes, and whether there are only null ids."""

    def __init__(self, kind: int):
        self.kind = kind

    def pack(self, cols):
        one, two, none, ids = cols
        return pack_sorted(one), squeeze(two.tobytes() + ids.tobytes() + none.tobytes())

    def unpack(self, a, b):
        one, rest = unpack_sorted(a), unsqueeze(b)
        n = len(one)
        return one, np.frombuffer(rest, U64, n), np.frombuffer(rest, bool, n, 16 * n), np.frombuffer(rest, np.int64, n, 8 * n)

    def merge(self, cols):
        one, two, none, ids = cols
        order = np.lexsort((two, one))
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])) if len(one) else np.zeros(0, np.int64)
        number = np.empty(len(one), np.int64)
        number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(one))))
        if not len(one):
            return cols, number
        first = order[starts]
        return (one[first], two[first], np.logical_and.reduceat(none[order], starts), np.minimum.reduceat(np.where(none, NO_ID, ids)[order], starts)), number

    def solve(self, cols):
        return cols[3], cols[2].astype(np.uint8)


def _forward(folds: dict[int, Fold], route: Route, level: int):
    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        fold = folds[rows[0]["kind"]]
        route.send(fold, rows[0]["dst"], level + 1, fold.merged(rows)[0], out)
        return pa.Table.from_batches([packets(out)])

    return run


def _final(folds: dict[int, Fold]):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        fold = folds[rows[0]["kind"]]
        cols, own = fold.merged(rows)
        answer = fold.solve(cols)
        return pa.Table.from_batches([packets([fold.reply(r, answer, o) for r, o in zip(rows, own)] + fold.extra(cols))])

    return run


def _back(folds: dict[int, Fold]):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [r for r in rows if r["kind"] < ANSWER]
        if not asked or asked[0]["kind"] not in folds:
            return table
        fold = folds[asked[0]["kind"]]
        cols, own = fold.merged(asked)
        answer = fold.answers(rows, len(cols[0]))
        return pa.Table.from_batches([packets([fold.reply(r, answer, o) for r, o in zip(asked, own)])])

    return run


def resolve(asked: DataFrame, folds: list[Fold], route: Route, label: str) -> DataFrame:
    """Answers (a written table) to packets sent with route.send at level 1.

    Tables of the hops and the shuffles that wrote them go as soon as nothing reads them again.
    """

    def written(df: DataFrame) -> DataFrame:
        with shuffles_removed(df.sparkSession):
            return cut(df, label)

    by = {f.kind: f for f in folds}
    down = [asked if route.hops == 1 else written(asked)]
    for level in range(1, route.hops):
        down.append(written(down[-1].groupBy("dst").applyInArrow(_forward(by, route, level), PACKET)))
    up = written(down[-1].groupBy("dst").applyInArrow(_final(by), PACKET))
    for level in range(route.hops - 1, 0, -1):
        drop(down[level])
        narrow, up = up, written(down[level - 1].unionAll(up).groupBy("dst").applyInArrow(_back(by), PACKET))
        drop(narrow)
    if route.hops > 1:
        drop(down[0])
    return up


# Hashing of words: vectorised over all bytes of a block.

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
POWER = np.cumprod(np.concatenate([[U64(1)], np.full(65535, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def spans(data: np.ndarray, off: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't separators (a table of 256); runs don't cross documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~is_sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    cuts = np.flatnonzero(edge)
    cuts = cuts[cuts < len(data)]
    starts = cuts[inside[cuts]]
    ends = np.append(cuts, len(data))[np.flatnonzero(inside[cuts]) + 1]
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs. fold: a table of 256 that maps bytes first (such as A-Z to a-z)."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    rel = np.arange(int(lens.sum())) - np.repeat(first, lens)
    value = BYTE[fold][data[rel + np.repeat(starts, lens)]] * POWER[rel & 0xFFFF]
    return mix(np.add.reduceat(value, first) ^ (lens.astype(U64) * U64(0xA24BAED4963EE407)))


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
