"""Hard negatives, packing and vector codes against brute force and the
tokenizers library."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopfloor.llm import best_fit_packing as P
from shopfloor.llm import queries as Q
from shopfloor.llm.byte_ids import byte_ids
from shopfloor.llm.hard_negatives import Forest, hard_negatives, str_tiles
from shopfloor.llm.vector_codes import codebooks_sha256, nearest, sequency_order, vector_codes, walsh

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "vec_id long, embedding array<double>, label int, doc string, q string, `_x` string"


def odd_vectors(spark, n=400, width=8, seed=3):
    """Nulls everywhere, non-finite components, repeated rows, equal vectors,
    ties, short and empty vectors and columns with clashing names."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = (rng.integers(-3, 4, width) / 4).tolist()
        rows.append((i, v, int(rng.integers(0, 4)), "d", None, "x"))
    rows += [(n, None, 1), (n + 1, [1.0, None] + [0.0] * (width - 2), 1), (n + 2, [math.nan] * width, 1), (n + 3, [math.inf] + [0.0] * (width - 1), 2)]
    rows += [(None, [0.5] * width, 1), (n + 4, [0.25] * width, None), (None, None, None), (n + 5, [1.0, 0.5], 3), (n + 6, [], 2)]
    rows += [(7, rows[7][1], rows[7][2]), (9, [0.75] * width, 2)] + [(n + 10 + k, [0.5] * width, k % 3) for k in range(60)]
    rows = [(*r, "d", None, "x") if len(r) == 3 else r for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def whole(vector, scale, width):
    if vector is None or any(v is None or not math.isfinite(v) for v in vector):
        return None
    return [math.floor(scale * v) for v in vector] + [0] * (width - len(vector))


# ------------------------------------------------------------ hard negatives
def brute_negatives(rows, anchor, label, width, k=5, scale=256):
    best = {}
    for i, v, lab in rows:
        q = whole(v, scale, width)
        if i is None or lab is None or q is None:
            continue
        best[i] = min(best.get(i, (label(i, lab), q)), (label(i, lab), q))
    out = set()
    for a, (la, qa) in best.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(qa, q, strict=True)) for i, (_, q) in best.items()}
        same = sorted((i for i, (lab, _) in best.items() if lab == la and i != a), key=lambda i: (-score[i], i))[:k]
        for p in same:
            hard = [i for i, (lab, _) in best.items() if lab != la and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            for r, i in enumerate(sorted(hard, key=lambda i: (-score[i], i))[:k], 1):
                out.add((a, p, r, i, score[p], score[i]))
    return out


def test_hard_negatives_of_odd_vectors(spark, monkeypatch):
    import shopfloor.llm.hard_negatives as H

    for name, v in (("LEAF_ROWS", 8), ("SLAB_ROWS", 100), ("FAN_OUT", 3), ("FOREST_LEAVES", 20), ("BLOCK_ANCHORS", 30)):
        monkeypatch.setattr(H, name, v)
    df = odd_vectors(spark)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    found = hard_negatives(df, anchor=F.col("id") % 5 == 0)
    wanted = brute_negatives(rows, lambda i: i % 5 == 0, lambda i, lab: lab, 8)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 500
    empty = hard_negatives(df.limit(0), anchor=F.col("id") % 5 == 0)
    assert empty.count() == 0 and empty.columns == found.columns
    with pytest.raises(ValueError):
        hard_negatives(df.withColumn("embedding", F.array(F.lit(1e15))), anchor=F.col("id") % 5 == 0)


def test_hard_negatives_query(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    wanted = brute_negatives(rows, lambda i: i % 100 == 0, lambda i, lab: (lab + 1) % 10 if i % 7 == 0 else lab, 64)
    got = [tuple(r) for r in Q.op11_hard_negatives(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted


def test_tiles_and_intervals():
    rng = np.random.default_rng(1)
    rows = rng.integers(-50, 50, (1000, 6))
    tiles = str_tiles(rows, 16)
    assert sorted(np.concatenate(tiles).tolist()) == list(range(1000)) and max(map(len, tiles)) <= 16
    leaves = [
        {"low": rows[t].min(0), "high": rows[t].max(0), "label_low": 0, "label_high": 0, "ids": t, "labels": t * 0, "q": rows[t].reshape(-1)}
        for t in tiles
    ]
    forest = Forest(leaves, 6)
    anchors = rng.integers(-50, 50, (5, 6))
    for exact in (True, False):
        low, high = forest.intervals(anchors, exact)
        for b in range(len(low[0])):
            inside, todo = [], [b]
            while todo:
                x = todo.pop()
                todo += forest.children[x] or []
                if forest.children[x] is None:
                    inside.append(forest.q[x])
            scores = anchors @ np.concatenate(inside).T
            assert (low[:, b] <= scores.min(1)).all() and (scores.max(1) <= high[:, b]).all()


# -------------------------------------------------------------- vector codes
def brute_codes(rows, width, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, whole(v, scale, width), lab) for i, v, lab in rows]
    kept = [x for x in kept if x[1] is not None]
    wide = width // parts
    cut = lambda q: [q[k * wide : (k + 1) * wide] for k in range(parts)]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[cut(q)[k] for _, q, _ in first] for k in range(parts)]

    def near(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        held = defaultdict(list)
        for _, q, _ in kept:
            for k, part in enumerate(cut(q)):
                held[k, near(part, books[k])[0]].append(part)
        for (k, e), some in held.items():
            books[k][e] = [math.floor(sum(c) / len(some)) if abs(sum(c)) < 1 << 40 else sum(c) // len(some) for c in zip(*some, strict=True)]
    out, by_label = [], defaultdict(int)
    for i, q, lab in kept:
        found = [near(p, b) for p, b in zip(cut(q), books, strict=True)]
        error = sum(d for _, d in found)
        by_label[lab] += error
        out.append((i, "".join(f"{c:02x}" for c, _ in found), error, lab))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab]) for i, c, e, lab in out), key=repr), digest


def test_vector_codes_of_odd_vectors(spark):
    df = odd_vectors(spark)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    for entries in (16, 256):
        coded, books = vector_codes(df, entries=entries)
        code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
        wanted, digest = brute_codes(rows, 8, entries=entries)
        got = coded.select("id", code, "error", "label_error").collect()
        assert sorted((tuple(r) for r in got), key=repr) == wanted
        assert codebooks_sha256(books) == digest
    coded, books = vector_codes(df.limit(0))
    assert coded.count() == 0 and all(len(b) == 0 for b in books)
    assert vector_codes(df.select("vec_id", F.slice("embedding", 1, 6).alias("embedding"), "label"))[0].count() > 400
    with pytest.raises(ValueError):
        vector_codes(df.withColumn("embedding", F.array(F.lit(1e15))))


def test_vector_codes_query(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = Q.op13_vector_codes(spark, SF).collect()
    wanted, digest = brute_codes(rows, 64)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == wanted and {r["codebooks_sha256"] for r in got} == {digest}


def test_walsh_keeps_distances():
    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 16):
        x, e = rng.integers(-9, 10, (300, width)), rng.integers(-9, 10, (20, width))
        size = walsh(x).shape[1]
        assert (np.square(walsh(x)).sum(1) == size * np.square(x).sum(1)).all()
        index, error = nearest(x, e)
        d = np.square(x[:, None] - e[None]).sum(-1)
        assert (index == d.argmin(1)).all() and (error == d.min(1)).all()
    rows = walsh(np.eye(16, dtype=np.int64)).T  # one Walsh function a row
    assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(16))
    assert sequency_order(1).tolist() == [0]


# ------------------------------------------------------------------- packing
ODD_TEXTS = [
    "", None, " ", "  a b", "a  b\n c ", "x<|endoftext|> y", "é à\x85 b", "a \x1cb c\x1fd", "don't  'll  \t x", "日本 語 x　y",
    "l1\n\nl2\n l3", "\n", "a\n", " foo bar's", "a b c", "it's we'll 12,345.67 #tags  <b>", "a" * 5000, "é" * 3000, " " * 2000 + "x",
]


def test_byte_ids_equal_the_library():
    coder = byte_ids(VOCAB)
    assert coder.quick
    some = [chr(c) for c in range(1, 0x3100)] + [chr(c) for c in range(0x3100, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    chars = ["".join(f"a{c}1{c}!{c} {c}b \n{c}" for c in some[a : a + 50]) for a in range(0, len(some), 50)]
    for texts in (ODD_TEXTS, chars, [*ODD_TEXTS, *chars][::-1]):
        wanted = [coder.whole([t or ""])[0] for t in texts]
        ids, count = coder.encode(pa.array(texts, pa.string()))
        assert count.tolist() == [len(w) for w in wanted] and (ids == np.concatenate(wanted)).all()
    assert [len(x) for x in coder.encode(pa.array([], pa.string()), 2)] == [0, 0]


def check_packing(rows, texts, limit, end_id=2):
    """Rows (doc, piece, start, length, crc, sequence, offset) of documents
    numbered by their place in ``texts``."""
    library, by_doc, by_sequence = byte_ids(VOCAB), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, text in enumerate(texts):
        ids = np.append(library.whole([text or ""])[0], end_id).astype("<u4")
        pieces = sorted(by_doc[d], key=lambda r: r[1])
        assert [r[1] for r in pieces] == list(range(-(-len(ids) // limit)))
        assert all(r[3] == limit for r in pieces[1:]) and sum(r[3] for r in pieces) == len(ids)
        at = 0
        for r in pieces:
            assert r[2] == at and r[4] == zlib.crc32(ids[at : at + r[3]].tobytes())
            at += r[3]
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r[6]):
            assert r[6] == at
            at += r[3]
        assert at <= limit
    return len(by_sequence)


def test_packing_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_PIECES", 40)
    rng = np.random.default_rng(4)
    texts = ODD_TEXTS + [" ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 60))) for _ in range(300)] + ["same text"] * 50
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, piece string, `row` string").repartition(3)
    pieces = P.pack_documents(df, VOCAB, limit=64, keep_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in pieces)
    names = ("doc", "piece", "start", "length", "ids_crc32", "sequence", "offset")
    used = check_packing([tuple(r[n] for n in names) for r in pieces], texts, 64)
    rest = [r["length"] for r in pieces if r["length"] < 64]
    needed = -(-sum(rest) // 64) + sum(r["length"] == 64 for r in pieces)
    assert used <= 1.02 * needed + 1
    nulls = spark.createDataFrame([(None, None), (None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r["length"] for r in P.pack_documents(nulls, VOCAB).collect()) == [1, 1, 2]
    assert P.pack_documents(df.limit(0), VOCAB).count() == 0


def test_packing_encodes_few_texts_at_once():
    size, n = 1000, 9000
    spans = P._spans(pa.array(["x" * size] * n + [None, "y" * 5_000_000, ""]))
    assert [b for _, b in spans[:-1]] == [a for a, _ in spans[1:]] and (spans[0][0], spans[-1][1]) == (0, n + 3)
    assert max(b - a for a, b in spans) * size <= 2_500_000
    assert P._spans(pa.array([], pa.string())) == [] and P._spans(pa.array([None, ""], pa.string())) == [(0, 2)]


def test_packing_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [tuple(r) for r in Q.op12_best_fit_packing(spark, SF).collect()]
    ids = sorted(texts)
    place = {d: k for k, d in enumerate(ids)}
    used = check_packing([(place[r[0]], *r[1:]) for r in rows], [texts[d] for d in ids], 1024)
    assert used <= 1.01 * (sum(r[3] for r in rows) / 1024) + 1


def test_breeding_keeps_every_piece_and_never_gets_worse():
    rng = np.random.default_rng(5)
    for n, most in ((1, 100), (2, 100), (50, 60), (400, 40), (300, 100)):
        sizes = np.sort(rng.integers(1, most, n))[::-1].astype(np.int64)
        first = P.fresh(np.arange(n), sizes, 100)
        plans = P.evolve(sizes, [], 100, seed=1)
        for p in plans:
            assert len(p) == n and np.bincount(p, weights=sizes).max() <= 100
        assert P.rank(plans[0], sizes) <= P.rank(first, sizes)
        child = P.cross(first, plans[-1], sizes, 100, rng)
        assert (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 100
    for n, most in ((300, 100), (50, 60)):
        sizes = np.sort(rng.integers(1, most, n))[::-1].astype(np.int64)
        plan = P.filled(sizes, 100)
        assert np.bincount(plan, weights=sizes).max() <= 100 and sorted(set(plan.tolist())) == list(range(plan.max() + 1))
    # best fit in descending order needs 3 bins of 10 here, two are enough
    sizes = np.array([5, 4, 4, 3, 2, 2], dtype=np.int64)
    assert P.rank(P.evolve(sizes, [], 10, seed=0, generations=40)[0], sizes)[0] == 2
