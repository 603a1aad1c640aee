"""Each operator against a brute-force version, with nulls, empty and odd texts, repeated rows and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lagwise.llm import chat_format, decontam, language_id, lm_scoring, packing, quality_rules, simhash_dedup, suffix_dedup, toxicity, url_filters
from lagwise.llm.packed import Route
from lagwise.llm.queries import URL_RULES
from lagwise.llm.shared import cut, shared_dir
from lagwise.llm.suffix_array import suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, kept string"
ANY = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ta", "ko", "é", "Li", "ber", "sun"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, out = prose(30), []
    for i in range(60):
        text = prose(r.choice([1, 2, 3, 25, 60, 400]))
        if i % 5 == 0:
            text += "\n" + shared + "\n" + prose(8)
        out.append([i, text, ["en", "fr", None][i % 3], "s" if i % 2 else None, len(text), "x", "y"])
    out += [[100 + i, out[7][1], "en", "s", None, None, None] for i in range(5)]
    out += [[200, None, None, None, None, None, None], [201, "", "en", "s", 0, "", ""], [None, out[3][1], "fr", "s", 1, "", ""], [202, " \t\n", "en", "s", 3, "", ""], [203, "# * $ 7", "en", "s", 7, "", ""]]
    out += [list(out[9]), [204, "ab " * 3000, "en", "s", 9000, "", ""], [205, out[11][1].upper(), "en", "s", 1, "", ""]]
    return [tuple(x) for x in out]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_suffix_array():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randint(0, r.choice([0, 1, 4])) for _ in range(r.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot,route", [(2048, None), (3, Route(3, 2))])
def test_suffix_dedup(docs, hot, route):
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, text, *_ in ROWS:
        b = (text or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, math.inf), key(i))
    want = []
    for i, text, *_ in ROWS:
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not p for p, g in zip([False, *gone], gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((key(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = [(key(r[0]), *r[1:]) for r in suffix_dedup.dedup(docs, route=route, hot=hot).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("gb,want", [(0.5, Route(1, 7)), (6, Route(1, 9)), (30, Route(1, 11)), (600, Route(2, 8))])
def test_one_hop_as_long_as_its_fan_can_widen(gb, want):
    """A second hop doubles the disk; gb: of Parquet, which counts four times."""
    size = int(4 * gb * 1e9)
    route = Route.for_size(size, suffix_dedup.SHARE)
    assert route == want and suffix_dedup.SHARE << route.bits * route.hops >= size


def test_hops_leave_no_tables_and_no_shuffles(spark, docs):
    top = shared_dir(spark).removeprefix("file://")
    tables = lambda: {x for x in os.listdir(top) if x.startswith(("dedup-anchors", "dedup-strings"))}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, conf = tables(), spark.conf.get(key)
    hops = suffix_dedup.dedup(docs, route=Route(2, 3))
    assert sorted(x.rsplit("-", 1)[0] for x in tables() - was) == ["dedup-anchors", "dedup-strings"]
    assert spark.conf.get(key) == conf
    wide = suffix_dedup.dedup(docs, route=Route(1, 11))
    assert sorted(map(str, hops.collect())) == sorted(map(str, wide.collect()))


def test_strip_keeps_columns(docs):
    out = suffix_dedup.strip(docs)
    assert out.dtypes == docs.dtypes and out.count() == len(ROWS)


def test_strip_of_wide_rows(spark):
    """Scans of different width come in different Arrow batches; blocks don't depend on them."""
    r = random.Random(6)
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(3000, 9000))) for _ in range(300)]
    texts[200] += texts[3][:200]
    d = spark.createDataFrame([(i, t, t * 2) for i, t in enumerate(texts)], "doc_id long, text string, wide string").coalesce(2)
    key, was = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(key, 200_000)
    try:
        got = {x.doc_id: x for x in suffix_dedup.strip(d).collect()}
    finally:
        spark.conf.set(key, was)
    assert len(got) == 300 and all(got[i].wide == t * 2 for i, t in enumerate(texts))
    assert {i for i, t in enumerate(texts) if got[i].text != t} == {200} and got[200].text == texts[200][:-200]


def test_the_greatest_id_is_not_a_null_one(spark):
    text = "every one of these sixty and more bytes stands in both of the two texts " * 2
    d = spark.createDataFrame([(2**63 - 1, text), (None, text), (-(2**63), "other"), (None, "other two")], "doc_id long, text string")
    got = {(x.doc_id, x.n_removed > 0) for x in suffix_dedup.dedup(d).collect()}
    assert got == {(2**63 - 1, False), (None, True), (-(2**63), False), (None, False)}
    held = {x.doc_id: x.held_out for x in lm_scoring.score(d, 7, zlib.crc32(str(2**63 - 1).encode()) % 7).collect()}
    assert held[2**63 - 1] and held.keys() == {2**63 - 1, None, -(2**63)}


@pytest.mark.parametrize("blocks", [1, 9, 60])
def test_packets_grow_with_the_input(blocks):
    """Each block sends at most 2**bits packets a kind; nodes are as many as buckets at every level."""
    from lagwise.llm.packed import Totals

    route, rng = Route(2, 3), np.random.default_rng(blocks)
    first, fold = [], Totals(10)
    for b in range(blocks):
        keys = np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64))
        route.send(fold, b, 1, (keys, np.ones(len(keys), np.int64)), first)
    assert blocks * 2**3 * 0.9 < len(first) <= blocks * 2**3
    nodes, second = {}, []
    for dst, src, kind, a, b in first:
        nodes.setdefault(dst, []).append({"src": src, "dst": dst, "kind": kind, "a": a, "b": b})
    for dst, rows in nodes.items():
        route.send(fold, dst, 2, fold.merged(rows)[0], second)
    assert len(nodes) <= 2**6 and len({x[0] for x in second}) <= 2**6 and len(second) <= 2**9


def simhash(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    fps = [simhash(t) for _, t, *_ in ROWS]
    comp = list(range(len(ROWS)))
    for _ in ROWS:
        comp = [min([comp[j] for j in range(len(ROWS)) if (fps[i] ^ fps[j]).bit_count() <= 2]) for i in range(len(ROWS))]
    least = {}
    for c, (i, *_) in zip(comp, ROWS):
        least[c] = min(least.get(c, math.inf), math.inf if i is None else i)
    want = sorted((str(i), f"{f:016x}", least[c]) for (i, *_), f, c in zip(ROWS, fps, comp))
    assert sorted((str(r[0]), r[1], r[2]) for r in simhash_dedup.classes(docs).collect()) == want
    kept = simhash_dedup.keep_one(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == len(least)


def near_classes(fp):
    """The number of classes of fingerprints under links of 2 bits, by brute force."""
    label = np.arange(len(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    while True:
        low = np.where(near, label[None, :], len(fp)).min(1)
        if (low == label).all():
            return len(set(label.tolist()))
        label = low


def joined_classes(fp, edges):
    parent = {int(x): int(x) for x in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert ((a ^ b) % 2**64).bit_count() <= 64
        parent[root(a % 2**64)] = root(b % 2**64)
    return len({root(int(x)) for x in fp})


@pytest.mark.parametrize("n,shared", [(100, (2, 3, 4, 5, 6, 7)), (700, (2, 3, 4, 5, 6, 7)), (3000, (2, 3, 4, 5, 6, 7)), (900, (4, 5, 6, 7))])
def test_forest_of_links(n, shared):
    r = random.Random(n)
    base = r.getrandbits(64)
    fp = np.array(sorted({base ^ (r.getrandbits(64 - 8 * len(shared)) & r.getrandbits(16)) for _ in range(n)}), np.uint64)
    assert joined_classes(fp, simhash_dedup.forest(fp, shared)) == near_classes(fp)


@pytest.mark.parametrize("most", [1024, 5])
def test_links_of_the_index(spark, most):
    r = random.Random(most)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
    fp = np.array(sorted(fps), np.uint64)
    edges = simhash_dedup.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), most).collect()
    assert joined_classes(fp, edges) == near_classes(fp)


def test_keep_one_with_clashing_columns(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text, 1, 5, {"a": 1}), (-(2**63), "a b c d", 2, 6, None), (2**63 - 1, text, 77, 7, {}), (2**63 - 1, text, 78, 8, {}), (5, None, 3, 9, None), (6, "", 4, 9, None)]
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, stay_id long, fp long, whole map<string,int>"))
    got = sorted((x.doc_id, x.stay_id, x.fp) for x in kept.collect())
    assert got in ([(-(2**63), 2, 6), (5, 3, 9), (2**63 - 1, 77, 7)], [(-(2**63), 2, 6), (5, 3, 9), (2**63 - 1, 78, 8)])
    assert kept.columns == ["doc_id", "text", "stay_id", "fp", "whole"]


def test_lm_base_and_model(docs):
    toks = {k: [*(w for w in ANY.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))), "</s>"] for k, (_, t, *_) in enumerate(ROWS)}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in ROWS]
    count = Counter(w for k, ws in toks.items() if not held[k] for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held[k], len(toks[k]), sum(count[w] > 0 for w in toks[k]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks[k]), 6)) for k, (i, *_) in enumerate(ROWS))
    got = lm_scoring.score(docs).collect()
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_lm_score_is_the_mixture(spark):
    """One block, so that the deleted counts can be worked out by hand: EM on the same held-out events, then the formula."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("the a of to in on it is at by".split()) for _ in range(r.randint(0, 30)))) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    grams = [[(*x,) for x in zip(["<", "<", *w], ["<", *w], [*w, ">"])] for w in (t.split() for _, t in rows)]
    tally = lambda use: [Counter(g[k:] for i in use for g in grams[i]) for k in range(3)]
    contexts = lambda use: [Counter(g[k:2] for i in use for g in grams[i]) for k in range(2)]
    docs = [i for i in range(80) if train[i]]
    full, full_c, n = tally(docs), contexts(docs), sum(len(grams[i]) for i in docs)
    v = len(full[2])
    cells = Counter()
    for part in range(4):
        held = [i for i in docs if i % 4 == part]
        own, own_c = tally(held), contexts(held)
        size = sum(len(grams[i]) for i in held)
        for g in (g for i in held for g in grams[i]):
            cuv, cv = (full_c[k][g[k:2]] - own_c[k][g[k:2]] for k in range(2))
            f = [(full[0][g] - own[0][g]) / max(1, cuv), (full[1][g[1:]] - own[1][g[1:]]) / max(1, cv), (full[2][g[2:]] - own[2][g[2:]]) / max(1, n - size)]
            b = min(math.frexp(cuv)[1], 23) if cuv else 24 + min(math.frexp(cv)[1], 23)
            cells[b, *(min(63, max(1, round(-2 * math.log2(x)) + 1)) if x else 0 for x in f)] += 1
    code = np.array([((b * 64 + x) * 64 + y) * 64 + z for b, x, y, z in cells])
    weights = lm_scoring.learn_weights(code, np.array(list(cells.values())), v)
    for route in (None, Route(2, 2)):
        got = {x.doc_id: x.score for x in lm_scoring.score(d, route=route).collect()}
        for i, gs in enumerate(grams):
            want = 0.0
            for g in gs:
                cuv, cv = full_c[0][g[:2]], full_c[1][g[1:2]]
                w = weights[min(math.frexp(cuv)[1], 23) if cuv else 24 + min(math.frexp(cv)[1], 23)]
                want += math.log10(w[0] * full[0][g] / max(1, cuv) + w[1] * full[1][g[1:]] / max(1, cv) + w[2] * full[2][g[2:]] / n + w[3] / (v + 1))
            assert got[i] == pytest.approx(want, abs=1e-6)


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in ROWS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(i), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids)))]
    got = packing.pack(docs, path).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts)) and sum(n for _, n in parts) <= 2048
    assert len(by) <= len(packing.best_fit([r.length for r in got])[2]) + 1


@pytest.mark.parametrize("seed", range(6))
def test_merges_place_every_item(seed):
    """Runs of a group against the items written out: each in one place, bins gapless and within capacity, none lost however many there are."""
    r = random.Random(seed)
    counts = {c: {r.randint(1, 64): r.choice([1, 2, 5, 400]) for _ in range(r.randint(0, 20))} for c in range(5)}
    bins, runs = {}, packing.runs_of(7, counts, 64)
    for child, lengths in counts.items():
        for n, c in lengths.items():
            for k in range(c):
                ((_, _, lo, _, delta, each, shift, fill, base, parent),) = [x for x in runs if x[:2] == (child, n) and x[2] <= k < x[3]]
                bins.setdefault((fill, base + (k + delta) // each), []).append((shift + (k + delta) % each * n, n))
    for (fill, _), parts in bins.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts)) and sum(parts[-1]) == fill <= 64
    lengths = [n for c in counts.values() for n, k in c.items() for _ in range(k)]
    fewest = packing.best_fit(lengths, 64)[2]
    assert sum(n for n, _ in packing.best_fit_counts({n: lengths.count(n) for n in set(lengths)}, 64)) == len(bins) <= len(fewest) * 1.02 + 1


def test_packing_over_many_partitions(spark):
    """More partitions than a merge takes, a length that never pairs, and empty texts that fill every last place."""
    import public_tokenizers

    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefg") for _ in range(r.choice([1, 3, 700, 1100, 1900, 2046])))) for i in range(1500)] + [(i, None) for i in range(1500, 2500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(37), str(public_tokenizers.path("byte_bpe_50k.json"))).collect()
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts)) and sum(parts[-1]) <= 2048
    assert len(got) == len({(x.doc_id, x.piece) for x in got}) and len({x.doc_id for x in got}) == 2500
    assert len(by) <= len(packing.best_fit([x.length for x in got])[2]) * 1.02 + 1


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    slow, fast = Tokenizer.from_file(path), packing.Encoder.load(path)
    assert fast.fast is not None
    for t in ["", "a  b\n\n c", "été 漢字 🙂 don't <|endoftext|> x", "   x\r\n\t", "1234 ab12 __!!"]:
        assert fast.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_decontamination(spark):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(k, prose(20)) for k in range(4)] + [(4, None), (5, ""), (6, "tiny item")]
    edited = items[1][1].split()
    edited[7] = "changed"
    rows = [(1, prose(50)), (2, prose(30) + ". " + items[0][1].upper() + ", " + prose(9)), (3, prose(5) + " " + " ".join(edited)), (4, None), (5, ""), (6, " ".join(items[2][1].split()[:9])), (7, "a tiny, item")]
    rows += [(k, prose(3) + " " + items[3][1]) for k in range(10, 150)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(d, b).collect()}
    assert got == {(2, 0), (3, 1), (7, 6)} | {(k, 3) for k in range(10, 150)}
    assert {x.doc_id for x in decontam.clean(d, b).collect()} == {1, 4, 5, 6}
    assert decontam.contaminated(d, b.limit(0)).count() == 0


def test_edited_copy_beside_many_exact_ones(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item = prose(20)
    edited = item.split()
    edited[6] = edited[13] = "changed"
    rows = [(k, prose(3) + " " + item) for k in range(200)] + [(200, prose(9) + " " + " ".join(edited) + " " + prose(9)), (201, prose(60))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = {x.doc_id: x.similarity for x in decontam.contaminated(d, b).collect()}
    assert got == {k: 1.0 for k in range(200)} | {200: 0.9}
    assert [x.doc_id for x in decontam.clean(d, b).collect()] == [201]


def test_seeds_miss_no_edited_copy():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    hashed = lambda t: decontam.words(*decontam.lowered(pa.array([t])))[0]
    items = [[word() for _ in range(n)] for n in (*range(1, 61), 200)]
    index = decontam.Index()
    for k, item in enumerate(items):
        index.add(k, hashed(" ".join(item)))
    index.build()
    texts, sure = [], set()
    for k, item in enumerate(items):
        edits = len(item) // 5
        for trial in range(8):
            copy = list(item)
            places = range(4, 5 * edits, 5) if trial == 0 else range(2, 5 * edits, 5) if trial == 1 else r.sample(range(len(item)), edits)
            for i in sorted(places, reverse=True):
                copy[i : i + 1] = [[word()], [], [copy[i], word()]][0 if trial < 2 else r.randrange(3)]
            texts.append(" ".join([*(word() for _ in range(12)), *copy, *(word() for _ in range(12))]))
            if decontam.align(hashed(" ".join(item)), hashed(texts[-1]))[1] >= decontam.SIMILARITY * len(item):
                sure.add((len(texts) - 1, k))
    assert len(sure) > 0.8 * len(texts)
    found = {x[:2] for x in decontam.Finder(index).find(pa.array(texts))}
    assert found == sure


@pytest.mark.parametrize("n", [257, 266, 520])
def test_no_tiny_piece_condemns(n):
    w = np.arange(n).astype(np.uint64)
    index = decontam.Index()
    index.add(0, w)
    assert (np.concatenate(index.words) == w).all() and all(decontam.PIECE // 2 <= len(x) <= decontam.PIECE for x in index.words)
    item = [f"w{k}" for k in range(n)]
    index = decontam.Index()
    index.add(0, decontam.words(*decontam.lowered(pa.array([" ".join(item)])))[0])
    texts = [" ".join(["clean", *item[-10:], "text"]), " ".join(item[-5:]), " ".join(["a", *item, "b"])]
    assert [x[0] for x in decontam.Finder(index.build()).find(pa.array(texts))] == [2]


def test_quality_counts(docs):
    def brute(text):
        t = text or ""
        w = ANY.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if ANY.search(line):
                dup += line in seen
                seen.add(line)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = Counter(win)
        cover = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(8)}
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)

    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.score(docs).collect())
    assert got == sorted((str(i), *brute(t)) for i, t, *_ in ROWS)
    clashing = docs.withColumns({"q": F.lit(1), "n_words": F.lit(2), "g_lang": F.lit(3), "row": F.lit(4)})
    kept = quality_rules.keep(clashing)
    assert kept.dtypes == clashing.dtypes and 0 < kept.count() < len(ROWS) and {(r.q, r.n_words, r.g_lang, r.row) for r in kept.collect()} == {(1, 2, 3, 4)}


@pytest.mark.parametrize("share", [1000, 2])
def test_quality_verdicts_equal_sql(spark, docs, share):
    """Whole verdicts against the SQL, with all groups broadcast and with most of them shuffled."""
    import duckdb

    con = duckdb.connect()
    for d in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        con.register("documents", pa.Table.from_pylist([r.asDict() for r in d.select("doc_id", "text", "lang", "source").collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])))
        want = sorted(map(repr, con.execute(quality_rules.SQL).fetchall()))
        measured = cut(quality_rules.measures(d.select("doc_id", "text", "lang", "source")).drop("text"), "measured")
        got = quality_rules.judge(measured, share).select("doc_id", *(f"q.{c}" for c in quality_rules.COUNTS[:5]), "q.base_failed", "kept").collect()
        assert sorted(repr(tuple(r)) for r in got) == want


def test_groups_get_their_own_fences(spark):
    """Code has symbols in every line, prose has none: the same document is junk in prose and usual in code."""
    r = random.Random(7)
    prose = lambda n, odd: " ".join("#" * 3 if k % 9 in odd else "w" + str(r.randrange(10**6)) for k in range(n))
    rows = [(i, prose(r.randint(60, 100), {8} if i % 2 else ()), "en", ["book", "code"][i % 2]) for i in range(1200)]
    rows += [(2000, prose(150, {3, 8}), "en", "book"), (2001, prose(150, {3, 8}), "en", "code"), (2002, prose(150, {1, 2, 3, 4, 5, 6}), "en", "code")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {x.doc_id for x in quality_rules.keep(d).collect()} == {*range(1200), 2001}
    own = {x.g_source: x.g_symbols for x in quality_rules.fences(quality_rules.sketch(quality_rules.measures(d))).collect()}
    assert own["code"] > own["book"]


def test_sketch_bucket(spark):
    got = spark.range(5000).select("id", quality_rules.bucket_top(F.col("id")).alias("t")).collect()
    assert all(r.id <= r.t <= r.id * 17 / 16 + 1 for r in got)


def test_urls(spark):
    rows = [(1, "http://Sub.EXAMPLE.net/en/x?q"), (2, "https://a.net/"), (3, "x.net/"), (4, None), (5, "http://example.com/de/1"), (6, "http://b.org/fr/#y"), (7, "http://b.org"), (8, "http://notexample.com/de/"), (2, "https://a.net/")]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict if r.rule else "") for r in url_filters.classify(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect())
    assert got == [(1, "sub.example.net", "/en/x", "example.net/en/", "allow"), (2, "a.net", "/", "net/", "block"), (2, "a.net", "/", "net/", "block"), (3, "", "", "", ""), (4, "", "", "", ""), (5, "example.com", "/de/1", "example.com/de/", "block"), (6, "b.org", "/fr/", "org/fr/", "allow"), (7, "b.org", "", "", ""), (8, "notexample.com", "/de/", "", "")]


def test_url_trees_learn_from_the_url(spark):
    """Labels that follow from the look of a URL and not from its suffix; four in five are given, the rest is judged."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    good = lambda: f"https://{word(6)}.{r.choice(['com', 'org', 'net'])}/{word(5)}/{word(8)}.html"
    bad = lambda: f"http://{word(4)}-{r.randrange(10**6)}.{r.choice(['com', 'org', 'net'])}/{r.randrange(10**8)}?a={r.randrange(99)}&b={word(3)}&c={r.randrange(10**5)}"
    rows = [(i, bad() if i % 3 == 0 else good(), 1.0 if i % 3 == 0 else 0.0) for i in range(900)]
    rows += [(900 + i, rows[3][1], 1.0) for i in range(200)]  # one URL many times
    pages = spark.createDataFrame([(i, u, "x") for i, u, _ in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(u, x) for i, u, x in rows if i % 5], "url string, label double")
    got = {x.page_id: x for x in url_filters.classify(pages, [("allow", "never.example", "/")], labels=labels).collect()}
    assert len(got) == 1100 and all(x.rule is None for x in got.values())
    held = [got[i].verdict == ("block" if x else "allow") for i, _, x in rows[:900] if i % 5 == 0]
    assert sum(held) >= 0.97 * len(held)


def test_suffix_rates_leave_the_own_rule_out(spark):
    rows = [(1, "net", "a", 1.0), (2, "net", "a", 1.0), (3, "net", "b", 0.0), (4, "net", None, None), (5, "com", "c", 1.0)]
    got = {x.page_id: (round(math.expm1(x.f_sfx_n)), x.f_sfx_rate) for x in url_filters.with_suffix_stats(spark.createDataFrame(rows, "page_id long, suffix string, rule string, label double")).collect()}
    s = url_filters.SMOOTHING
    assert got == {1: (4, s / 2 / (1 + s)), 2: (4, s / 2 / (1 + s)), 3: (4, (2 + s / 2) / (2 + s)), 4: (4, (2 + s / 2) / (3 + s)), 5: (1, 0.5)}


CALL = "conv_id long, turn long, idx int, call_id string, name string, arguments string, refs array<string>"
ANSWER = "conv_id long, turn long, call_id string, content string"


@pytest.mark.parametrize("small", [64, 0])
def test_chat(spark, small):
    schemas = {"say": {"text": ("string", True), "chars": ("integer", True)}, "put": {"text": ("integer", False), "deep": ("object", False), "some": ("array", False), "x": ("number", False), "ok": ("boolean", False)}, "none": {}}
    calls = [
        (1, 0, 0, "a", "say", '{"text": "7", "chars": 1}', ["b", "b", None]), (1, 2, 0, "b", "say", '{"chars":"5\\n","text":"q\\""}', []), (1, 4, 0, "c", "other", None, ["d"]), (1, 6, 0, "d", "say", '{"text":"t","more":1}', ["c"]), (1, 7, 0, "e", "say", '{"text":"t","chars":1}', ["c", "a"]),
        (2, 0, 0, "a", "say", '{"chars":2,"text":"é"}', ["zz"]), (1, 0, 0, "a", "say", '{"text": "7", "chars": 1}', ["b", "b", None]), (None, 0, 0, None, "say", None, None), (None, 0, 0, "n", "none", "{}", None),
        (3, 0, 0, "p", "put", '{ "x": 1.50, "text": "5", "deep": {"z": 1, "a": [2, {"q":null,"b":1}]}, "some": [], "ok": true}', None), (3, 0, 1, "q", "put", '{"text":5,"deep":[],"some":{},"x":"1","ok":null}', None), (3, 1, 0, "r", "put", "[1]", None), (3, 2, 0, "s", "put", '{"x":1,"x":2}', None), (3, 3, 0, "t", "none", '{"x":1}', None),
    ]
    results = [(1, 1, "a", "ok"), (1, 9, "zz", "lost"), (2, 1, "a", None)]
    got = {(r.conv_id, r.call_id): r for r in chat_format.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, ANSWER), schemas, small).collect()}
    assert len(got) == 14
    assert [got[1, c].level for c in "abcde"] == [1, 0, -1, -1, -1]
    assert got[1, "a"].status == "linked" and got[1, "zz"].status == "orphan" and got[1, "b"].status == "unanswered"
    assert got[1, "b"].errors == "chars is not integer" and got[1, "d"].errors == "missing chars; unknown more" and got[1, "c"].errors == "unknown tool" and got[1, "a"].errors == ""
    assert got[1, "a"].canonical_json == '{"arguments":{"chars":1,"text":"7"},"id":"a","name":"say","result":"ok"}'
    assert got[3, "p"].canonical_json.startswith('{"arguments":{"deep":{"a":[2,{"b":1,"q":null}],"z":1},"ok":true,"some":[],"text":"5","x":1.5},') and got[3, "p"].errors == "text is not integer"
    assert got[3, "q"].errors == "deep is not object; ok is not boolean; some is not array; x is not number"
    assert got[3, "r"].errors == got[3, "s"].errors == "arguments are no JSON object" and got[3, "r"].canonical_json.startswith('{"arguments":"[1]",') and got[3, "t"].errors == "unknown x"
    assert [r.call_id for r in sorted((r for (c, _), r in got.items() if c == 1), key=lambda r: r.position)] == ["c", "d", "e", "b", "zz", "a"]
    assert got[None, None].position is None and got[None, "n"].errors == ""


@pytest.mark.parametrize("small", [64, 3])
def test_chat_order_by_brute_force(spark, small):
    """Random references, cycles among them, against depth-first longest chains."""
    r = random.Random(small)
    calls, want = [], {}
    for conv in range(12):
        n = r.randint(1, 12)
        refs = {t: [u for u in r.sample(range(n + 2), min(n, r.randint(0, 2))) if u != t or r.random() < 0.2] for t in range(n)}
        if r.random() < 0.6:
            refs = {t: [u for u in us if u > t] for t, us in refs.items()}
        calls += [(conv, t, 0, f"c{t}", "say", "{}", [f"c{u}" for u in us]) for t, us in refs.items()]

        def depth(t, seen):
            if t in seen:
                return math.inf
            return max([depth(u, seen | {t}) + 1 for u in refs[t] if u < n], default=0)

        twisted = any(t <= u < n for t, us in refs.items() for u in us)
        for t in range(n):
            d = depth(t, frozenset()) if twisted else 0
            want[conv, f"c{t}"] = -1 if d == math.inf else d
    got = chat_format.link(spark.createDataFrame(calls, CALL), spark.createDataFrame([], ANSWER), chat_format.TURN_SCHEMA, small).collect()
    assert {(x.conv_id, x.call_id): x.level for x in got} == want
    for conv in range(12):
        own = sorted((x for x in got if x.conv_id == conv), key=lambda x: x.position)
        assert [x.position for x in own] == list(range(len(own))) and [(x.level, x.turn) for x in own] == sorted((x.level, x.turn) for x in own)


def test_chat_from_messages(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"x","name":"say","arguments":{"chars":2,"text":"a b"}},{"id":"y","name":"say","arguments":"{\\"chars\\":3}"},{"id":"z","name":"say"}]}'), (1, 2, "tool", '{"tool_call_id":"x","content":"done"}'), (1, 3, "assistant", "{broken"), (1, 4, "tool", "no json"), (2, 0, None, None)]
    calls, results = chat_format.turns_as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.call_id: x for x in chat_format.link(calls, results, chat_format.TURN_SCHEMA).collect()}
    assert got["x"].canonical_json == '{"arguments":{"chars":2,"text":"a b"},"id":"x","name":"say","result":"done"}' and got["x"].status == "linked"
    assert got["y"].errors == "missing text" and got["z"].errors == "missing chars; missing text"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.link(*chat_format.turns_as_calls(empty), chat_format.TURN_SCHEMA).count() == 0


def test_language(spark):
    r = random.Random(2)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(40))
    rows = [(i, make(["th", "er", "ing"] if i % 2 else ["eau", "oi", "ç"]), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 34", "en"), (102, "", None), (None, make(["th", "er"]), None)]
    got = {x.doc_id: x for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") and 0 < got[i].score <= 1 for i in range(60))
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und" and got[None].lang_pred == "en"
    assert got[3].held_out == (zlib.crc32(b"3") % 5 == 0)


def test_toxicity(spark):
    r = random.Random(4)
    make = lambda bad: " ".join(r.choice(["table", "chair", "window", "garden", "river"]) if not bad or k % 7 else r.choice(["scoundrelly", "scoundrelish"]) for k in range(r.randint(30, 90)))
    rows = [(i, make(i % 3 == 0)) for i in range(300)] + [(900, None), (901, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in got if x.held_out and x.doc_id < 300]
    assert len(got) == 302 and held and all(x.predicted == int(x.doc_id % 3 == 0) for x in held)
    assert all(0 <= x.score <= 1 for x in got)


def test_empty_tables(none, spark):
    assert quality_rules.score(none).count() == quality_rules.keep(none).count() == 0
    assert simhash_dedup.classes(none).count() == simhash_dedup.keep_one(none).count() == 0
    assert suffix_dedup.dedup(none).count() == suffix_dedup.strip(none).count() == 0
    assert lm_scoring.score(none).count() == language_id.identify(none).count() == 0
    assert toxicity.score(none, none.select("doc_id", F.lit(1).alias("toxic"))).count() == 0
    assert decontam.contaminated(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert url_filters.classify(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), URL_RULES).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "sequences"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert ids == {r.doc_id for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [1 for r in docs.collect() for t in items if t in r.text]


def test_word_models_are_kneser_ney():
    """Each word's difference against the formula, with counts held in dicts."""
    r = random.Random(12)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)})
    counts = np.array([[r.randint(0, 4), r.randint(0, 4)] for _ in words])
    order, shared, d = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT

    def grams(word, n):
        """(context of n - 1 symbols, symbol) at each place; `^` pads the beginning, `$` ends the word."""
        s = "^" * order + word + "$"
        return [(s[i - n + 1 : i], s[i]) for i in range(order, len(s))]

    def counted(pairs):
        c, t, k = Counter(), Counter(), Counter()
        for g, n in pairs:
            if n > 0:
                k[g[0]] += g not in c
                c[g] += n
                t[g[0]] += n
        return c, t, k

    levels = []
    for n in range(1, order + 1):
        if n <= shared:
            longer = {(a, b) for w in words for (a, b) in zip((g[0] for g in grams(w, n + 1)), grams(w, n))}
            levels.append([counted([(g, 1) for _, g in sorted({(x[0][:1], x[1]) for x in longer})])] * 2)
        else:
            levels.append([counted([(g, int(counts[i, q])) for i, w in enumerate(words) for g in grams(w, n)]) for q in (0, 1)])

    def log_p(word, q):
        out = 0.0
        for i in range(len(word) + 1):
            p = 1 / 257
            for n, level in enumerate(levels, 1):
                c, t, k = level[q]
                g = grams(word, n)[i]
                if t[g[0]]:
                    p = (max(c[g] - d, 0) + d * k[g[0]] * p) / t[g[0]]
            out += math.log(p)
        return out

    model = toxicity.Model.learn([w.encode() for w in words], counts)
    asked = [*words, "abcabca", "zz", "c"]
    for w, x in zip(asked, model.differences([w.encode() for w in asked])):
        assert x == pytest.approx(log_p(w, 1) - log_p(w, 0), abs=1e-6)


def test_toxicity_features():
    class Known(toxicity.Scorer):
        def words(self, hashes, spell):
            return np.array([{b"aa": 1.0, b"b": -2.0, b"ccc": 5.0}[bytes(spell(i))] for i in range(len(hashes))])

    texts = [b"aa b aa ccc aa", b"", b"1 2", b"b b b"]
    off = np.cumsum([0, *map(len, texts)])
    got = Known(None).features(np.frombuffer(b"".join(texts), np.uint8), off)
    assert got == pytest.approx(np.array([[4 / 3, 5, 4 / 3, math.log(3)], [0, 0, 0, 0], [0, 0, 0, 0], [-2, -2, -2, 0]]))


def test_out_of_place_by_brute_force(spark):
    """Profiles and distances against counters and sorted lists: equal counts go by code point on both sides."""
    r = random.Random(11)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))
    kinds = {"en": ["th", "er", "ba"], "fr": ["eau", "oi", "ç"], "zh": ["漢", "字", "語"]}
    rows = [(i, make(kinds[lang], r.choice([1, 2, 5, 60])) + r.choice(["", " 12!", "\nÉ"]), lang) for i, lang in enumerate(r.choice(list(kinds)) for _ in range(90))]
    rows += [(100, None, "en"), (101, "7", "fr"), (102, "ba", None), (103, "x" * 5000, None), (102, "ba", None)]

    def grams(text):
        s = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        words = [f" {w} " for w in s.split()]
        return Counter(g for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]).strip() and (n < 3 or g[1] != " "))

    top = lambda c: sorted(c, key=lambda g: (-c[g], g))[: language_id.PROFILE]
    total = {}
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 5:
            total.setdefault(lang, Counter()).update(grams(t))
    profiles = {k: {g: n for n, g in enumerate(top(c))} for k, c in sorted(total.items())}
    learned = language_id.learn(spark.createDataFrame([x for x in rows if zlib.crc32(str(x[0]).encode()) % 5], "doc_id long, text string, lang string"))
    assert {k: list(v) for k, v in profiles.items()} == learned
    want = []
    for i, t, _ in rows:
        own = top(grams(t))
        if not own:
            want.append((i, "und", 0.0))
            continue
        far = {k: sum(abs(p[g] - n) if g in p else language_id.PROFILE for n, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        want.append((i, best, round(1 - far[best] / (len(own) * language_id.PROFILE), 9)))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((x.doc_id, x.lang_pred, round(x.score, 9)) for x in got) == sorted(want)


def test_chains_are_aligned_in_windows():
    item = [f"w{k}" for k in range(40)]
    index = decontam.Index()
    index.add(0, decontam.words(*decontam.lowered(pa.array([" ".join(item)])))[0])
    index.build()
    seen = []
    old = decontam.align
    try:
        decontam.align = lambda a, b: seen.append(len(b)) or old(a, b)
        text = " ".join((item[:10] + item[10:34]) * 300 + ["x"] + item)
        found = decontam.Finder(index).find(pa.array([text, " ".join(item[:10] * 500)]))
    finally:
        decontam.align = old
    assert found[0][:3] == (0, 0, 1.0) and len(found) == 1 and max(seen) <= 2 * 40 + 2 * (8 + 10)


@pytest.mark.parametrize("every,least", [(12, 0.99), (8, 0.99), (5, 0.9)])
def test_recall_of_edited_copies(spark, every, least):
    """Of the benchmark's own items with one word in `every` changed, left out or put in, how many are found."""
    r = random.Random(every)
    items = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("text").orderBy("item_id").limit(150).collect()]
    index = decontam.Index()
    texts = []
    for k, item in enumerate(items):
        index.add(k, decontam.words(*decontam.lowered(pa.array([item])))[0])
        w = item.split()
        for i in sorted(r.sample(range(len(w)), len(w) // every), reverse=True):
            w[i : i + 1] = r.choice([["changed"], [], [w[i], "more"]])
        texts.append(" ".join(["before"] * 20 + w + ["after"] * 20))
    found = {x[:2] for x in decontam.Finder(index.build()).find(pa.array(texts))}
    print("recall", every, sum((k, k) in found for k in range(len(items))) / len(items))
    assert sum((k, k) in found for k in range(len(items))) >= least * len(items)
