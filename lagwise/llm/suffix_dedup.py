"""Removal of 50-byte strings that a document with a smaller id also has.

Texts are UTF-8 bytes; a byte goes if some LENGTH-byte string over it also starts in a
document with a smaller doc_id. Strings are judged on the input.

Suffix arrays of everything together would need everything in one place, so:

1. Anchors. In every LENGTH-byte string the smallest hash among its CORE-byte substrings
   picks an anchor, a choice made by the string alone, so equal strings have equal anchors
   at equal places (about one byte in ten is one). Blocks ask hash buckets, in packed form
   (packed.py), which anchors more than one text has, and for each text the least id with
   exactly that text. Copies of a text are decided by that alone: all of it goes.
2. Contexts. For anchors that are shared, a block sends the bytes around them that a string
   with that anchor can reach, once per distinct context with its least id. A bucket meets
   all contexts of an anchor. Where an anchor has several contexts with a string in common,
   their suffixes are sorted by linear grouping over Lyndon prefixes (suffix_array.py),
   neighbours in that order with equal first LENGTH bytes form a run, and the run's least
   id belongs to its string. The core, equal in all of them, counts as one symbol there.
3. Each block gets the least id of each string and removes what has a smaller one.

A passage in a third of all documents is one context per block and a handful per bucket; at
its edges, where every document goes on otherwise, contexts differ. So the strings of anchors
with HOT places or more go to buckets of their own hash, one by one, and no bucket meets more
than HOT contexts of one anchor. Nothing is capped: every shared string is found. Cores are
compared by 128 bits of hash, everything else byte by byte. Anchors are least hashes, so they
are hashed once more before buckets are chosen, which spreads them evenly.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; a text of any length
is worked on whole, in chunks of CHUNK bytes while anchors are sought; a null doc_id counts as
larger than all others and is returned as null, and null ids aren't smaller than one another;
nor are rows with the same doc_id (all of them lose what a smaller id has); repeated rows are
returned each; an empty table gives an empty result. Columns other than doc_id and text, of any
name, are ignored by dedup and come back unchanged from strip, but for n_chars.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .packed import BYTE, DOCS, NO_ID, PACKET, ROWS, U64, Block, Fold, LeastId, Route, Totals, ascending, blocks, mix, pack_sorted, packets, resolve, rows_sent, send_docs, send_rows, squeeze, sum_by_key, unpack_sorted, unsqueeze
from .shared import stable, text_size
from .suffix_array import suffix_array

LENGTH, CORE = 50, 32
#: Places of an anchor in a string; the bytes that a string can reach before and after the core.
PLACES = LENGTH - CORE + 1
REACH = PLACES - 1
ANCHORS, CLASSES, CONTEXTS, STRINGS = 10, 11, 12, 13
#: Anchors with this many places or more are too common to meet in one bucket: their strings are sent one by one.
HOT = 2048
#: Bytes of text whose anchors a bucket meets: more buckets only cost smaller packets, a second hop twice the disk.
SHARE = 64 << 20
#: Symbols sorted at a time: whole anchors, so a little more where one has many contexts.
SORTED = 1 << 17
#: Contexts looked at together.
SLICE = 1 << 13
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 17
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FULL = RESULT + ", kept binary, removed array<struct<start:long,end:long>>"


def core_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the CORE bytes from each position. CORE is a power of two: hashes double up."""
    h, step = BYTE[data], 1
    while step < CORE:
        h = h[: len(h) - step] * U64(pow(BASE, step, 1 << 64)) + h[step:]
        step *= 2
    return mix(h)


def _slide(x: np.ndarray, width: int, low) -> np.ndarray:
    """low over every window of `width` neighbours."""
    step = 1
    while 2 * step <= width:
        x = low(x[: len(x) - step], x[step:])
        step *= 2
    return low(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a block's texts."""
    at, hashes = [], []
    for lo in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        # the strings that start in this chunk; their anchors may come again from the next
        part = data[max(0, lo - REACH) : min(len(data), lo + CHUNK + LENGTH + REACH)]
        h = core_hashes(part)
        if len(h) < PLACES:
            continue
        least = _slide(h, PLACES, np.minimum)
        padded = np.concatenate([np.zeros(REACH, U64), least, np.zeros(REACH, U64)])
        picked = np.flatnonzero(_slide(padded, PLACES, np.maximum) == h)
        at.append(picked + max(0, lo - REACH))
        hashes.append(h[picked])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    pos, first = np.unique(np.concatenate(at), return_index=True)
    h = mix(np.concatenate(hashes)[first])  # least hashes lie close together: spread them
    doc = np.searchsorted(off, pos, "right") - 1
    inside = pos + CORE <= off[doc + 1]
    return pos[inside], h[inside]


def _texts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole text."""
    raw = np.ascontiguousarray(block.data).data
    cuts = list(zip(block.off[:-1].tolist(), block.off[1:].tolist()))
    return np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in cuts], U64), np.array([xxhash.xxh3_64_intdigest(raw[i:j], 1) for i, j in cuts], U64)


def _classes(block: Block) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """A block's distinct texts as LeastId asks about them, and each document's class."""
    one, two = _texts(block)
    return LeastId(CLASSES).merge((one, two, block.none, block.ids))


class Anchors(Totals):
    """Totals of texts (low half) and places (high half), each clipped where it no longer matters; answers 0: one text, 1: several, 2: hot."""

    def __init__(self, hot: int):
        super().__init__(ANCHORS)
        self.hot = hot

    def merge(self, cols):
        (keys, sums), number = super().merge(cols)
        return (keys, np.minimum(sums & 0xFFFFFFFF, 2) | np.minimum(sums >> 32, self.hot) << 32), number

    def solve(self, cols):
        several = (cols[1] & 0xFFFFFFFF) > 1
        return (several.astype(np.uint8) + (several & (cols[1] >> 32 >= self.hot)),)


def _ask(route: Route, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            name, asked = b.name, []
            distinct_texts, of = _classes(b)
            route.send(LeastId(CLASSES), name, 1, distinct_texts, asked)
            keys, counts, _, _ = _anchor_keys(b, of)
            route.send(Anchors(hot), name, 1, Anchors(hot).merge((keys, counts))[0], asked)
            yield packets(asked)

    return run


def _anchor_keys(block: Block, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors, ascending by hash; in how many of the block's distinct texts (low half) and places (high half) each is; all places; their anchors."""
    pos, h = anchors(block.data, block.off)
    keys, places, number = sum_by_key(h, np.ones(len(h), np.int64))
    pairs = ascending(number * len(of) + of[block.doc_of(pos)])
    return keys, np.bincount(pairs // max(1, len(of)), minlength=len(keys)) | places << 32, pos, number


class Contexts:
    """The distinct contexts of a block's shared anchors, ascending by anchor, and where they occur."""

    def __init__(self, block: Block, rows: list[dict]):
        texts, of = _classes(block)
        self.least, self.least_none = (x[of] for x in LeastId(CLASSES).answers(rows, len(texts[0])))
        keys, _, pos, number = _anchor_keys(block, of)
        shared, _ = Anchors(0).answers(rows, len(keys))
        doc = block.doc_of(pos)
        # copies are decided already; of equal texts with equal ids one is enough, but all are marked
        first = (block.none[doc] & (self.least_none[doc] > 0)) | (~block.none[doc] & (block.ids[doc] == self.least[doc]))
        often = np.where(first, shared[number], 0) if len(pos) else np.zeros(0, np.uint8)
        self._strings(block, pos[often == 2], doc[often == 2])
        h, pos, doc = keys[number][often == 1], pos[often == 1], doc[often == 1]
        before, after = np.minimum(REACH, pos - block.off[doc]), np.minimum(REACH, block.off[doc + 1] - pos - CORE)
        around = np.concatenate([np.arange(-REACH, 0), np.arange(CORE, CORE + REACH)])
        where = pos[:, None] + around[None, :]
        outside = np.concatenate([around[None, :REACH] < -before[:, None], around[None, REACH:] >= CORE + after[:, None]], 1)
        body = np.where(outside, 0, block.data[np.clip(where, 0, max(0, len(block.data) - 1))]).astype(np.uint8) if len(pos) else np.zeros((0, 2 * REACH), np.uint8)
        raw = np.ascontiguousarray(block.data).data
        check = np.array([xxhash.xxh3_64_intdigest(raw[p : p + CORE]) for p in pos.tolist()], U64)
        self.pos, self.doc = pos, doc
        self.contexts, self.of = distinct(h, check, body, np.stack([before, after], 1).astype(np.uint8), block.none[doc], block.ids[doc])

    def _strings(self, block: Block, pos: np.ndarray, doc: np.ndarray) -> None:
        """The distinct strings of very common anchors: two hashes, least id; where each occurrence starts."""
        start = (pos[:, None] - REACH + np.arange(PLACES)[None, :]).ravel()
        doc = np.repeat(doc, PLACES)
        inside = (start >= block.off[doc]) & (start + LENGTH <= block.off[doc + 1])
        self.start, first = np.unique(start[inside], return_index=True)
        self.start_doc = doc[inside][first]
        raw = np.ascontiguousarray(block.data).data
        one = np.array([xxhash.xxh3_64_intdigest(raw[p : p + LENGTH]) for p in self.start.tolist()], U64)
        two = np.array([xxhash.xxh3_64_intdigest(raw[p : p + LENGTH], 1) for p in self.start.tolist()], U64)
        self.strings, self.string_of = LeastId(STRINGS).merge((one, two, block.none[self.start_doc], block.ids[self.start_doc]))


def valid(sides: np.ndarray) -> np.ndarray:
    """Which of the PLACES strings of each context lie inside its document."""
    place = np.arange(PLACES)[None, :]
    return (place >= REACH - sides[:, :1].astype(np.int64)) & (place <= sides[:, 1:].astype(np.int64))


def distinct(key, check, body, sides, none, ids):
    """Distinct contexts ascending by key, the least id of each (none: there are only null ones), and each entry's context."""
    n = len(key)
    if not n:
        return (key, check, body, sides, none, ids), np.zeros(0, np.int64)
    powers = np.cumprod(np.full(2 * REACH + 2, BASE, np.uint64), dtype=np.uint64)
    parts = [(np.concatenate([body[k : k + SLICE], sides[k : k + SLICE]], 1) * powers).sum(1, dtype=np.uint64) for k in range(0, n, SLICE)]
    print_ = mix(np.concatenate(parts) + mix(check))
    order = np.lexsort((print_, key))
    k, p = key[order], print_[order]
    starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])]))
    of = np.empty(n, np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    first = order[starts]
    if not ((check == check[first][of]).all() and (body == body[first][of]).all() and (sides == sides[first][of]).all()):
        raise RuntimeError("two contexts have the same 128-bit hash")
    least = np.minimum.reduceat(np.where(none, NO_ID, ids)[order], starts)
    return (key[first], check[first], body[first], sides[first], np.logical_and.reduceat(none[order], starts), least), of


class Shared(Fold):
    """Contexts (key, check, body, sides, none, ids): answers with the least id of each of their PLACES strings, and whether there are only null ids."""

    kind, width = CONTEXTS, PLACES

    def pack(self, cols):
        key, check, body, sides, none, ids = cols
        return pack_sorted(key), squeeze(b"".join([check.tobytes(), ids.tobytes(), none.tobytes(), np.ascontiguousarray(sides).tobytes(), np.ascontiguousarray(body).tobytes()]))

    def unpack(self, a, b):
        key, raw = unpack_sorted(a), unsqueeze(b)
        n = len(key)
        sides = np.frombuffer(raw, np.uint8, 2 * n, 17 * n).reshape(n, 2)
        body = np.frombuffer(raw, np.uint8, 2 * REACH * n, 19 * n).reshape(n, 2 * REACH)
        return key, np.frombuffer(raw, np.uint64, n), body, sides, np.frombuffer(raw, bool, n, 16 * n), np.frombuffer(raw, np.int64, n, 8 * n)

    def merge(self, cols):
        return distinct(*cols)

    def solve(self, cols):
        key, n = cols[0], len(cols[0])
        least, none = np.repeat(cols[5][:, None], PLACES, 1), np.repeat(cols[4][:, None], PLACES, 1).astype(np.uint8)
        # whole anchors at a time
        new = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), n)
        ends = np.unique(np.append(new[np.searchsorted(new, np.arange(0, n, SLICE))], n))
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
            least[i:j], none[i:j] = least_ids(*(x[i:j] for x in cols))
        return least, none


def _ask_contexts(route: Route):
    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for d in [r for r in rows if r["kind"] == DOCS][:1]:
            c = Contexts(Block.unpack(d["a"], d["b"]), rows)
            route.send(Shared(), d["dst"], 1, c.contexts, out)
            route.send(LeastId(STRINGS), d["dst"], 1, c.strings, out)
        return pa.Table.from_batches([packets(out)])

    return run


def least_ids(key, check, body, sides, none, ids) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts ascending by key, the least id that has each of their PLACES strings, and whether only null ids have it."""
    n = len(key)
    least, only_none = np.repeat(ids[:, None], PLACES, 1), np.repeat(none[:, None], PLACES, 1)
    if n < 2:
        return least, only_none
    core = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1])]))
    # a key whose cores differ after all is told apart by the second hash
    order = np.lexsort((check, core))
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(np.concatenate([[False], (np.diff(core[order]) != 0) | (check[order][1:] != check[order][:-1])]))
    ok = valid(sides)
    cells = np.concatenate([body[:, :REACH].astype(np.int64) + 2, group[:, None] + 258, body[:, REACH:].astype(np.int64) + 2], 1)
    # candidates: contexts one of whose strings has the same hash as another context's
    powers = np.cumprod(np.full(PLACES, BASE, np.uint64), dtype=np.uint64)
    prints = np.stack([(cells[:, o : o + PLACES].astype(np.uint64) * powers).sum(1, dtype=np.uint64) for o in range(PLACES)], 1)
    prints = mix(prints + np.arange(PLACES, dtype=np.uint64)[None, :])
    _, number, count = np.unique(prints[ok], return_inverse=True, return_counts=True)
    common = np.zeros(ok.shape, bool)
    common[ok] = count[number] > 1
    some = np.flatnonzero(common.any(1))
    if not len(some):
        return least, only_none
    for part in np.array_split(some, max(1, len(some) * (2 * REACH + 2) // SORTED)) if len(some) else []:
        part = _whole_groups(part, some, group)
        if not len(part):
            continue
        rows = cells[part].copy()
        outside = np.concatenate([np.arange(REACH)[None, :] < REACH - sides[part, :1].astype(np.int64), np.zeros((len(part), 1), bool), np.arange(REACH)[None, :] >= sides[part, 1:].astype(np.int64)], 1)
        rows[outside] = 1
        text = np.concatenate([rows, np.zeros((len(part), 1), np.int64)], 1)
        width = text.shape[1]
        order = np.array(suffix_array(text.ravel().tolist()), np.int64)
        row, col = order // width, order % width
        use = (col < PLACES) & ok[part][row, np.minimum(col, PLACES - 1)]
        row, col = row[use], col[use]
        string = rows[row[:, None], col[:, None] + np.arange(PLACES)[None, :]]
        starts = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]).any(1)]))
        size = np.diff(np.append(starts, len(row)))
        least[part[row], col] = np.repeat(np.minimum.reduceat(ids[part][row], starts), size)
        only_none[part[row], col] = np.repeat(np.logical_and.reduceat(none[part][row], starts), size)
    return least, only_none


def _whole_groups(part: np.ndarray, some: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The members of `some` whose group begins in part: no group is sorted in two pieces."""
    g = group[some]
    order = np.argsort(g, kind="stable")
    ranked, sorted_g = some[order], g[order]
    lo, hi = np.searchsorted(some, part[0]), np.searchsorted(some, part[-1]) + 1
    begins = np.searchsorted(sorted_g, sorted_g, "left")
    return np.sort(ranked[(begins >= lo) & (begins < hi)])


def _remove(full: bool, schema: pa.Schema | None = None):
    """schema: that of the documents, where their own rows with what is left of their texts are wanted."""
    names = [x.strip().split()[0] for x in RESULT.split(",")]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        sent = [r for r in rows if r["kind"] == DOCS]
        if not sent:
            raise RuntimeError("answers came for a block that wasn't sent: the input was read in another order")
        block = Block.unpack(sent[0]["a"], sent[0]["b"])
        c = Contexts(block, rows)
        least, none = Shared().answers(rows, len(c.contexts[0]))
        smaller = lambda least, none, doc: (none == 0) & (block.none[doc] | (least < block.ids[doc]))
        gone = np.zeros(len(block.data) + 1, np.int32)
        for k in range(0, len(c.pos), SLICE):
            of, doc = c.of[k : k + SLICE], c.doc[k : k + SLICE, None]
            which, place = np.nonzero(smaller(least[of], none[of], doc) & valid(c.contexts[3][of]))
            start = c.pos[k + which] - REACH + place
            np.add.at(gone, start, 1)
            np.add.at(gone, start + LENGTH, -1)
        least, none = LeastId(STRINGS).answers(rows, len(c.strings[0]))
        start = c.start[smaller(least[c.string_of], none[c.string_of], c.start_doc)] if len(c.start) else c.start
        np.add.at(gone, start, 1)
        np.add.at(gone, start + LENGTH, -1)
        size = np.diff(block.off)
        copy = smaller(c.least, c.least_none, np.arange(len(block.ids))) & (size >= LENGTH)
        np.add.at(gone, block.off[:-1][copy], 1)
        np.add.at(gone, block.off[1:][copy], -1)
        gone = np.cumsum(gone)[:-1] > 0
        runs = gone.copy()
        runs[1:] &= ~gone[:-1]
        begin = block.off[:-1][size > 0]
        runs[begin] = gone[begin]
        upto, starts_upto = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(runs)])
        n_removed = upto[block.off[1:]] - upto[block.off[:-1]]
        n_spans = starts_upto[block.off[1:]] - starts_upto[block.off[:-1]]
        kept = [np.ascontiguousarray(block.data[i:j][~gone[i:j]] if r else block.data[i:j]).tobytes() for i, j, r in zip(block.off[:-1], block.off[1:], n_removed)]
        if schema is not None:
            for r in (r for r in rows if r["kind"] == ROWS):
                text = pa.array([x.decode("utf-8", "ignore") for x in kept])
                changed = pa.array(n_removed > 0)
                cols = {"text": text} | {c: rest.column(c) for rest in [rows_sent(r)] for c in rest.column_names}
                if "n_chars" in cols:
                    cols["n_chars"] = pc.if_else(changed, pc.utf8_length(text).cast(cols["n_chars"].type), cols["n_chars"])
                out.append(pa.table([cols[f.name].cast(f.type) for f in schema], names=schema.names))
            return pa.concat_tables(out)
        cols = [block.id_column(), pa.array(size.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        head = list(names)
        if full:
            spans = []
            for i, j in zip(block.off[:-1], block.off[1:]):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[i:j].astype(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            cols += [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            head += ["kept", "removed"]
        out += [pa.RecordBatch.from_arrays(cols, names=head)] * len(sent)
        return pa.Table.from_batches(out)

    return run


def dedup(docs: DataFrame, full: bool = False, route: Route | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; full: also the kept bytes and removed spans."""
    rows = stable(docs.select("doc_id", "text"), "dedup-docs")
    return _exchange(rows, rows.mapInArrow(send_docs, PACKET), route, hot).applyInArrow(_remove(full), FULL if full else RESULT)


def strip(docs: DataFrame, route: Route | None = None, hot: int = HOT) -> DataFrame:
    """docs with repeated strings removed from text (bytes of a character that was cut go too), and n_chars made to fit."""
    docs = stable(docs, "dedup-docs")
    sent = docs.mapInArrow(send_rows, PACKET)
    return _exchange(docs.select("doc_id", "text"), sent, route, hot).applyInArrow(_remove(False, to_arrow_schema(docs.schema)), docs.schema)


def _exchange(rows: DataFrame, sent_back: DataFrame, route: Route | None, hot: int):
    """What each block needs, grouped by block: its documents as sent_back has them, and the answers to what it asked."""
    route = route or Route.for_size(text_size(rows), SHARE)
    met = resolve(rows.mapInArrow(_ask(route, hot), PACKET), [LeastId(CLASSES), Anchors(hot)], route, "dedup-anchors")
    asked = rows.mapInArrow(send_docs, PACKET).unionAll(met).groupBy("dst").applyInArrow(_ask_contexts(route), PACKET)
    least = resolve(asked, [Shared(), LeastId(STRINGS)], route, "dedup-strings")
    return sent_back.unionAll(met).unionAll(least).groupBy("dst")


#: `dedup` over a table `documents`, in DuckDB's dialect: every string of every text, as hexadecimal digits (c: texts in chunks, which overlap, since substr walks from the start).
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, doc_id, j, substr(h, 512 * j + 1, {512 + 2 * LENGTH - 2}) AS c FROM (SELECT rid, doc_id, h, unnest(range(0, length(h) // 512 + 1)) AS j FROM d)),
s AS (SELECT rid, coalesce(doc_id, 9223372036854775808::HUGEINT) AS id, 256 * j + i AS i, substr(c, 2 * i + 1, {2 * LENGTH}) AS k FROM (SELECT rid, doc_id, j, c, unnest(range(0, least(256, length(c) // 2 - {LENGTH - 1}))) AS i FROM c)),
m AS (SELECT k, min(id) AS least FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM s JOIN m USING (k) WHERE least < id),
run AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS r FROM hit),
span AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS z FROM run GROUP BY rid, r),
part AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS from_ FROM span),
gone AS (SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(z) AS last FROM part JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN gone USING (rid)"""
