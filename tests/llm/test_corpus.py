"""Operators over the whole corpus, against brute force on small tables."""

import collections
import math
import random
import re
import zlib

import pytest

import corpus_pipeline
from shopfloor.llm.components import components
from shopfloor.llm.decontaminate import common_subsequence, find_leaks, subsequence_masks
from shopfloor.llm.lm_score import lm_scores
from shopfloor.llm.shingle_join import _runs, _spanning, bands_for, near_duplicates, sketch_words
from tests.llm.conftest import pairs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


# ------------------------------------------------------------ shingle join
def brute_classes(rows, width, percent):
    sets = collections.defaultdict(list)
    for d, t in rows:
        w = words(t)
        n = max(1, len(w) - width + 1)
        sets[d].append(frozenset(tuple(w[i : i + width]) for i in range(n)) if w else frozenset())
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = [d for d in sets if d is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return sorted([(d, len(s), find(d) if s and d is not None else d) for d, own in sets.items() for s in own], key=repr)


def copies(rnd, groups=25, size=6, vocabulary=4000):
    rows = []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, vocabulary)}" for _ in range(rnd.randint(1, 160))]
        for _ in range(rnd.randint(1, size)):
            own = list(base)
            for _ in range(rnd.randint(0, 1 + len(own) // 60)):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 10**6)}"
            rows.append(own)
    # one large group of near copies, so that words are shared by many sets
    base = [f"g{i}" for i in range(120)]
    for k in range(60):
        own = list(base)
        for _ in range(k % 4):
            own[rnd.randrange(len(own))] = f"y{rnd.randint(0, 10**6)}"
        rows.append(own)
    # many documents around one passage, that are no copies
    for k in range(40):
        rows.append([f"z{rnd.randint(0, 10**6)}" for _ in range(60)] + base[:40])
    rnd.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_classes(spark, width, percent, seed):
    rows = copies(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, near_duplicates(docs, width=width, percent=percent).collect()), key=repr)
    assert got == brute_classes(rows, width, percent)


def test_classes_odd_rows(odd_docs):
    got = sorted(map(tuple, near_duplicates(odd_docs).collect()), key=repr)
    assert got == brute_classes(pairs(odd_docs), 5, 80)
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_repeated_id_links_its_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (7, b), (9, "")], "doc_id long, text string")
    assert {(r["doc"], r["component_id"]) for r in near_duplicates(docs).collect()} == {(5, 3), (3, 3), (7, 3), (9, 9)}


def test_close_large_ids_are_groups_of_their_own():
    import pyarrow as pa

    big = 1 << 60
    row = {"k": 1, "lo": 0, "hi": 0, "b": None, "low": True, "n": 100, "own": 3, "sketch": bytes(128), "above": bytes(128)}
    rows = [row | {"a": a, "group": big + a} for a in (1, 2, 3)]
    failed = row | {"a": 1, "b": 2, "group": None, "low": None, "n": None, "own": None, "sketch": None, "above": None}
    kinds = {"k": "int64", "lo": "int32", "hi": "int32", "a": "int64", "b": "int64", "group": "int64", "low": "bool_", "n": "int32", "own": "int32"}
    schema = pa.schema([(c, getattr(pa, t)()) for c, t in kinds.items()] + [("sketch", pa.binary()), ("above", pa.binary())])
    batch = pa.RecordBatch.from_pylist([rows[0], failed, *rows[1:]], schema=schema)
    out = _spanning([batch], bands_for(80), 8).to_pylist()
    # (1, 2) failed before; 3 must still meet one of them
    assert (1, 3) in {(r["a"], r["b"]) for r in out}


def test_bands_hold_every_linked_pair():
    for percent in (80, 85):
        bands = bands_for(percent)
        for s in range(1, 200):
            for t in range(s, 260):
                if 100 * s >= percent * t:
                    common = set(bands.of(s)) & set(bands.of(t))
                    assert common
                    for j in common:
                        m, spare = bands.pieces(j)
                        assert bands.differ(s, t) + spare < m


def test_linked_sets_share_a_kept_word():
    import numpy as np

    rnd = np.random.default_rng(4)
    for percent in (80, 85):
        bands = bands_for(percent)
        for n in (1, 2, 5, 9, 17, 40, 130, 700, 3000):
            for _ in range(40):
                own = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
                # as many changes as a linked pair may have, some of them added only
                gone = (100 - percent) * n // (100 + percent)
                keep = rnd.permutation(own)[gone:]
                new = rnd.integers(0, 1 << 64, int(rnd.integers(0, gone + 1)), dtype=np.uint64)
                other = np.unique(np.concatenate([keep, new]))
                if bands.linked(len(np.intersect1d(own, other)), len(own), len(other)):
                    common = set(bands.of(len(own))) & set(bands.of(len(other)))
                    assert any(set(sketch_words(own, j, bands)) & set(sketch_words(other, j, bands)) for j in common)


def test_crowded_words_name_their_least_set():
    import numpy as np

    k, h = np.repeat([1, 2, 3], [12, 3, 9]), np.arange(24)
    rows = [r for b in _runs(k, h, None) for r in b.to_pylist()]
    assert {(r["k"], r["a"], r["b"]) for r in rows if r["many"]} == {(1, 0, x) for x in range(12)} | {(3, 15, x) for x in range(15, 24)}
    assert {(r["a"], r["b"]) for r in rows if not r["many"]} == {(12, 13), (12, 14), (13, 14)}
    # a word that runs on keeps the least set of its rows before
    rows = [r for b in _runs(k[:2], h[:2], (1, -7)) for r in b.to_pylist()]
    assert [(r["many"], r["a"], r["b"]) for r in rows] == [(True, -7, 0), (True, -7, 1)]


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, 5000 + i) for i in range(200)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in list(least) if find(x) != x}


# ------------------------------------------------------------------ LM score
def test_lm(spark):
    rnd = random.Random(3)
    tongues = [[f"{p}{a}{b}" for a in "aeiou" for b in "lmnrst"] for p in ("th", "qu", "sch")]
    rows = [(i, " ".join(rnd.choice(tongues[i % 3]) for _ in range(rnd.randint(1, 200)))) for i in range(300)]
    rows += [(1000, "entirely unknown"), (1001, "")]
    got = {r["doc"]: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    check_base(rows, got)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got.values())


def test_lm_learns_from_every_word_before(spark):
    # 6,000 words, more than the hashed rows, each of which fixes the next
    # word and, two places on, the one after
    rnd = random.Random(4)
    name = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4 + k % 5))
    chain = [name(k) for k in range(6000)]
    rows = []
    for i in range(600):
        at = rnd.randrange(len(chain))
        rows.append((i, " ".join(chain[(at + k) % len(chain)] for k in range(150))))
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = [r for r in got if r["held_out"]]
    per_token = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    base = sum(r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    print(per_token, base)
    assert per_token > base + 1.0  # the class alone is worth 2.4


def check_base(rows, got):
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    tokens = {d: [*words(t), "\n"] for d, t in rows}
    count = collections.Counter(w for d in tokens if not held[d] for w in tokens[d])
    total, distinct = sum(count.values()), len(count)
    for d, own in tokens.items():
        r = got[d]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d], len(own), total)
        assert r["n_known"] == sum(count[w] > 0 for w in own) and r["base_score"] == pytest.approx(base)


def test_lm_odd_rows(spark, odd_docs):
    out = lm_scores(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(math.isfinite(r["score"]) for r in out)
    assert all(not r["held_out"] for r in out if r["doc"] is None)
    assert lm_scores(odd_docs.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"]) == (0, 0, 0.0)


# ----------------------------------------------------------- decontamination
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    import numpy as np

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(1, 80))] for _ in range(2))
        assert common_subsequence(subsequence_masks(np.array(a)), len(a), b) == lcs(a, b)


def test_leaks(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rnd.choice(vocabulary[: rnd.choice([60, 3000])]) for _ in range(n)]
    items = {i: text(rnd.randint(12, 70)) for i in range(40)}
    rows, planted = [], set()
    for d in range(500):
        own = text(rnd.randint(5, 300))
        if d % 4 == 0:
            i = rnd.randrange(40)
            leak = list(items[i])
            if d % 8 == 0:  # a paraphrase: some words of the first half changed
                for _ in range(len(leak) // 8):
                    leak[rnd.randrange(len(leak) // 2)] = rnd.choice(vocabulary)
            at = rnd.randint(0, len(own))
            own = own[:at] + leak + own[at:]
            planted.add((d, i))
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc"], r["item"]) for r in find_leaks(docs, bench).collect()}
    assert got <= planted
    assert len(got) >= 0.9 * len(planted)


def planted_leaks(docs, items, rnd, hosts=1500):
    """Documents with each item in one of them, by how it was changed: a share
    of all its words replaced before its answer, or as many inserted."""
    texts = [t for _, t in docs if t]
    foreign = [w for t in texts[-200:] for w in t.split()]
    rows, plants = [], {}
    for kind, share in (("replaced", 0), ("replaced", 0.25), ("replaced", 0.4), ("inserted", 0.2), ("inserted", 0.4)):
        for item, text in items:
            leak = text.split()
            head = len(leak) - len(re.split(r"(?<=[.!?])\s+|\n", text.strip())[-1].split())
            n = int(share * len(leak))
            if kind == "replaced":
                for i in rnd.sample(range(head), min(head, n)):
                    leak[i] = rnd.choice(foreign)
            else:
                for _ in range(n):
                    leak.insert(rnd.randrange(len(leak) + 1), rnd.choice(foreign))
            host = texts[len(rows) % hosts].split()[:600]
            at = rnd.randint(0, len(host))
            size = len(text.split())
            length = "15-24" if size < 25 else "25-39" if size < 40 else "40-59"
            plants[len(rows), item] = (kind, share, length)
            rows.append((len(rows), " ".join(host[:at] + leak + host[at:])))
    return rows, plants


def test_leaks_by_length_and_change(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    docs = sorted(map(tuple, read("documents").where("doc_id < 2500").select("doc_id", "text").collect()))
    items = sorted(map(tuple, read("benchmark").select("item_id", "text").collect()))
    rows, plants = planted_leaks(docs, items, random.Random(12))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench)
    got = {(r["doc"], r["item"]) for r in out.select("doc", "item").collect()}
    recall = {}
    for group in sorted(set(plants.values())):
        own = [p for p, g in plants.items() if g == group]
        recall[group] = sum(p in got for p in own) / len(own)
    print(recall)
    assert min(recall.values()) >= 0.9, recall


def test_leaks_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame(
        [(1, "one two three", "x"), (1, "one two three", "y"), (2, None, "x"), (3, "", "x"), (None, "word5 a5. word6 a6. word7 a7. word8 a8. word9 a9.", "z")],
        "item_id long, text string, cosine string",
    )
    got = {(r["doc"], r["item"]) for r in find_leaks(odd_docs, bench).collect()}
    assert got >= {(9, 1), (10, 1)} and got <= {(9, 1), (10, 1), (6, None), (7, None)}
    assert find_leaks(odd_docs.limit(0), bench).count() == 0
    assert find_leaks(odd_docs, bench.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, odd_docs, tmp_path):
    rnd = random.Random(11)
    prose = lambda n: "\n".join(" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 400)) for _ in range(15)) + "." for _ in range(n))
    leak = " ".join(f"q{i}" for i in range(40))
    twin = prose(30)
    clean = [(100 + i, prose(8)) for i in range(20)]
    changed = twin.split("\n")
    changed[3] = prose(1)
    rows = [*clean, (200, twin), (201, "\n".join(changed)), (300, prose(4) + "\n" + leak + ".\n" + prose(4)), (400, "Home | News | Shop | Map\n" * 60)]
    bench = spark.createDataFrame([(1, leak + ".")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd_docs.unionByName(plain, allowMissingColumns=True)
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == odd_docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert {d for d, _ in clean} <= seen[-1]
    assert 400 not in seen[0] and 3 not in seen[0] and 300 in seen[2] and 300 not in seen[3]
    assert len({200, 201} & seen[1]) == 2
    empty = spark.createDataFrame([], odd_docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_columns_of_any_type(spark):
    rows = [(1, "some words of a text that is short.", {"a": 1}, [1.0]), (1, "other words of a text that is short.", {"b": 2}, None), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, n array<double>")
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").columns == docs.columns, name
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]
    assert tuple(kept[0 if kept[0]["doc_id"] == 1 else 1]) in [(d, t, m, n) for d, t, m, n in rows]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from shopfloor.llm.tables import shared_dir

    session = lambda path: SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: path), sparkContext=SimpleNamespace(master="spark://host:7077")
    )
    assert shared_dir(session("file:///shared/folder/")) == "file:///shared/folder"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(None))
