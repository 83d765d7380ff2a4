"""What the text operators keep in one task and on disk as their input grows."""

import os
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from shopfloor.llm import decontaminate, lm_score, shingle_join, tables
from shopfloor.llm.shingle_join import near_duplicates
from shopfloor.llm.tables import materialise, shared_dir


def test_feature_counts_are_added_a_range_at_a_time():
    """Sums as brute force has them, in little more than what comes and goes
    (24 bytes a key; all at once took 70)."""
    rng = np.random.default_rng(1)
    keys = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (400_000, 3, 600_000)]
    keys += [keys[0][::3], keys[2][1::7], keys[0][:1]]
    counts = [rng.integers(0, 1 << 40, len(k)) for k in keys]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(known), np.int64)
    np.add.at(sums, at, np.concatenate(counts))
    wanted = np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1])
    sent = [lm_score._wide(np.diff(k, prepend=np.uint64(0))) for k in keys], [lm_score._wide(c) for c in counts]
    total = sum(map(len, keys))
    tracemalloc.start()
    got = lm_score.add_counts(*sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((lm_score._from_wide(g) == w).all() for g, w in zip(got, wanted, strict=True))
    assert peak < 50 * total, peak / total


def test_a_block_of_features_is_no_larger_than_a_chunk(spark):
    """Whatever the number of chunks, a task adds up about as many feature
    keys as one chunk has."""
    rng = np.random.default_rng(5)
    rows = [(i, False, " ".join(f"w{k}" for k in rng.integers(0, 3000, 400))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc long, held boolean, text string").repartition(8)
    chunks = materialise(lm_score.chunk_table(docs))
    sizes = lm_score.feature_counts(chunks).groupBy("block").agg((F.sum(F.length("counts")) / 8).alias("n")).collect()
    per_chunk = sum(r["n"] for r in sizes) / chunks.count()
    assert chunks.count() > 1 and max(r["n"] for r in sizes) < 1.3 * per_chunk


def test_softmax_in_columns():
    z = np.random.default_rng(2).normal(size=(1000, lm_score.GROUPS)).astype(np.float32)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    np.testing.assert_allclose(lm_score._softmax(z.copy()), (e / e.sum(axis=1, keepdims=True)).T, rtol=1e-6)


def test_term_sums_of_rare_and_frequent_terms():
    rng = np.random.default_rng(2)
    for terms, words in ((40, 5000), (3000, 5000), (1, 50), (5, 1)):
        t, own = rng.integers(0, terms, words) ** 2 % decontaminate.BUCKETS, np.arange(words) // 32
        latent = rng.standard_normal((own[-1] + 1, 9)).astype(np.float32)
        wanted = np.zeros((decontaminate.BUCKETS, 9))
        np.add.at(wanted, t, latent[own])
        at, sums = decontaminate._term_sums(latent, own, t)
        assert (at == np.unique(t)).all() and np.allclose(sums, wanted[at], atol=1e-3)


def _folders(spark):
    path = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_near_duplicates_leave_no_text_on_disk(spark):
    """What is stored after the call is a few numbers a document."""
    before = _folders(spark)
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: F.md5(F.concat_ws("-", i, (F.col("id") / 3).cast("int"))))).alias("text"),
    )
    labels = near_duplicates(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 2, F.concat("text", F.lit(" end"))).otherwise(F.col("text"))))
    left = _folders(spark) - before
    path = shared_dir(spark)
    columns = [set(spark.read.parquet(f"{path}/{f}").columns) for f in left]
    assert len(left) == 3 and not any({"text", "set", "sketch", "k"} & c for c in columns), columns
    groups = {r["doc"]: r["component_id"] for r in labels.collect()}
    assert groups == {d: d - d % 3 for d in range(600)}


def test_written_tables_leave_no_shuffle_files(spark):
    """A table's shuffle files go when it is written, without waiting for the
    driver's garbage collector, and the session's setting is as before."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = spark.conf.get(tables.CLEANUP, None)

    def held():
        files = manager.getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    tables.release(spark)
    time.sleep(1)
    had = held()
    rows = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = materialise(rows)
    for _ in range(100):  # the files go in the background
        if held() <= had:
            break
        time.sleep(0.1)
    assert held() <= had and kept.count() == 1000
    assert spark.conf.get(tables.CLEANUP, None) == before


def test_a_sketch_has_a_few_bits_a_piece():
    """Sketches travel with every pair and every crowded word: 16 bits a piece,
    and the distance stays a lower bound of the sets' difference."""
    bands, rng = shingle_join.bands_for(80), np.random.default_rng(5)
    for n in (1, 3, 20, 300, 5000):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        j = bands.own(len(own))
        m, spare = bands.pieces(j)
        other = np.unique(np.append(own[len(own) // 9 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)))
        s, t = (shingle_join.bit_sketch(x, j, bands) for x in (own, other))
        assert len(s) == len(t) == 8 * -(-(m - spare) // 4)
        assert shingle_join._hamming(s, t) <= len(np.setxor1d(own, other))


def test_sums_by_term_come_from_few_tasks(spark):
    """Tasks that each send a sum for every term are not as many as the files."""
    cores = spark.sparkContext.defaultParallelism
    table = spark.range(0, 1000, 1, 6 * cores)
    assert decontaminate._few_tasks(table).rdd.getNumPartitions() == 2 * cores
    many = spark.range(0, 1000, 1, 2 * cores * decontaminate.SHARED * 2)
    assert decontaminate._few_tasks(many).rdd.getNumPartitions() == 4 * cores


def test_sums_by_term_and_windows_against_loops():
    rng = np.random.default_rng(2)
    latent = rng.standard_normal((40, 5)).astype(np.float32)
    t = np.minimum(rng.geometric(0.02, 6000), 400)
    own = np.sort(rng.integers(0, 40, len(t)))
    at, sums = decontaminate._term_sums(latent, own, t)
    assert at.tolist() == sorted(set(t.tolist()))
    np.testing.assert_allclose(sums, [latent[own[t == x]].sum(axis=0) for x in at], rtol=1e-4, atol=1e-4)
    sizes = np.array([5, 1, 3, 9, 2])  # cells of each text
    text, last = np.repeat(np.arange(5), sizes), np.cumsum(sizes)
    total = np.append(0, np.cumsum(rng.integers(0, 99, 20))).reshape(-1, 1)
    for steps in (1, 2, 3, 9, 12, 30):
        start, end, real = decontaminate._windows(text, last, steps)
        want = {(a, min(a + steps, b)) for a0, b in zip(last - sizes, last) for a in range(a0, b) if a == a0 or a + steps <= b}
        assert sorted(zip(start[real].tolist(), end[real].tolist())) == sorted(want)
        assert (decontaminate._differences(total, start, end, steps) == total[end] - total[start]).all()


def test_packed_planes_are_small_and_come_back():
    counts = np.random.default_rng(3).geometric(0.7, 50_000)
    data = lm_score._wide(counts)
    packed = lm_score._packed(data)
    assert len(packed) < 15_000 and (lm_score._from_wide(lm_score._unpacked(packed)) == counts).all()
    assert (lm_score._from_wide(lm_score._unpacked(lm_score._packed(b""))) == np.zeros(0)).all()
