"""The corpus pipeline against brute force: every stage in plain Python or SQL on a small fixture."""

import math
import random
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lagwise.llm import decontam, packing, quality_rules

from .test_llm import simhash

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row long, q string, k long, whole string, kept boolean, fp long"


def fixture():
    r = random.Random(21)
    word = lambda: "".join(r.choice(["ta", "ko", "é", "li", "ber", "sun", "mo"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(18) for _ in range(3)]
    passage, out = prose(25), []
    for i in range(50):
        text = prose(r.choice([5, 30, 60, 300]))
        if i % 6 == 0:
            text += "\n" + passage + "\n" + prose(8)
        if i % 9 == 0:
            text += ". " + items[i % 3] + " " + prose(6)
        if i % 11 == 0:
            text = " ".join(w + " ###" for w in text.split())
        out.append((i, text))
    edited = items[1].split()
    edited[8] = "changed"
    out += [(60, prose(20) + " " + " ".join(edited) + " " + prose(10)), (61, None), (62, ""), (63, " \n\t"), (None, prose(40)), (None, out[2][1]), (64, out[3][1]), (2, out[2][1]), (65, "word " * 400), (66, out[7][1] + " end"), (2**63 - 1, prose(40) + " " + passage)]
    rows = [(i, t, ["en", "fr", None][k % 3], "s" if k % 2 else None, None if t is None else len(t), k, "q", -k, None, None, k) for k, (i, t) in enumerate(out)]
    return rows, items


def order(i):
    return math.inf if i is None else i


def brute(rows, items):
    """(doc_id, text) after the four filtering stages."""
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": pa.array([x[1] for x in rows]), "lang": pa.array([x[2] for x in rows], pa.string()), "source": pa.array([x[3] for x in rows], pa.string())}))
    good = {x[0] for x in con.execute(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall()}
    docs = [(x[0], x[1]) for k, x in enumerate(rows) if k in good]
    fps = [simhash(t) for _, t in docs]
    comp = list(range(len(docs)))
    for _ in docs:
        comp = [min(comp[j] for j in range(len(docs)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(docs))]
    docs = [min((d for c, d in zip(comp, docs) if c == k), key=lambda d: order(d[0])) for k in sorted(set(comp))]
    first = {}
    for i, t in docs:
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], math.inf), order(i))
    out = []
    for i, t in docs:
        b, gone = t.encode(), set()
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order(i):
                gone.update(range(k, k + 50))
        out.append((i, bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")))
    hashed = lambda t: decontam.words(*decontam.lowered(pa.array([t])))[0]
    return [(i, t) for i, t in out if not any(decontam.align(hashed(x), hashed(t))[1] >= decontam.SIMILARITY * len(hashed(x)) for x in items)]


def write(spark, path, rows, items):
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_run_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, items = fixture()
    sf = write(spark, tmp_path, rows, items)
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    left = brute(rows, items)
    assert 10 < len(left) < len(rows) - 15
    want = []
    for i, t in left:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids)))]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((str(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts)) and sum(parts[-1]) <= packing.CAPACITY
    assert len(by) <= len(packing.best_fit([x.length for x in got])[2]) + 1


def test_columns_pass_through(spark, tmp_path):
    rows, items = fixture()
    sf = write(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    types, by = docs.dtypes, {(x[0], x[5]): x for x in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.dtypes == types, name
        docs = corpus_pipeline.cut(docs, name)
    for x in docs.collect():
        was = by[x.doc_id, x.row]
        assert (x.lang, x.source, x.q, x.k, x.whole, x.kept, x.fp) == (was[2], was[3], was[6], was[7], was[8], was[9], was[10])
        assert x.text == was[1] or x.n_chars == len(x.text)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, tmp_path, name):
    sf = write(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf).count() == 0
