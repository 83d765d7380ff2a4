"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of words hashed to ``BUCKETS`` terms.  A
distributed randomised SVD of the TF-IDF passages gives a latent space: every
task adds up its share of A'A times a thin matrix, Spark sums the shares, and
the driver orthogonalises (bounded: terms by dimensions).  Every window of
every document is then compared with every benchmark item of its length by
cosine in that space, whitened so that what a whole language shares does not
drown what a passage has of its own.  The threshold is low, as a paraphrased
short item is a small part of its window; windows above it that hold enough of
the item's words are verified by the longest common subsequence of words with
the item, and by whether the item's answer (its last sentence) is there.

Counts, SVD and search cover all words of all documents; items are taken in
blocks of ``ITEM_BLOCK``, so that a task holds one block whatever the size of
the benchmark.

Defined cases: a null or empty text has no windows; a null or wordless item
matches nothing; a document shorter than an item is one window; an item of
fewer than ``MIN_WORDS`` words must be there word for word; repeated rows of
either table are reported once for each (document, item); null ids are kept
as ids; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.tables import materialise, release
from shopfloor.llm.words import mix, split, text_slices

_U = np.uint64
BUCKETS = 16_384
RANK, EXTRA = 128, 8
#: Words of a passage for the SVD, and of the grid on which windows begin.
PASSAGE, GRID = 32, 8
ITEM_BLOCK = 512
MIN_WORDS = 8
#: Occurrences from which on a term's sum goes by parts of so many.
OFTEN = 16
#: Input splits that share one task where a task's result does not grow with
#: what it reads.
SHARED = 8
#: Words handled at once by a task, in sums by term (which cost less, the more
#: of a term's occurrences come together), and whose vectors are gathered at
#: once (which then stay in a core's own cache).
SLICE_WORDS, SUM_WORDS, GATHER_WORDS = 8192, 100_000, 1024


def word_table(docs: DataFrame) -> DataFrame:
    """(doc, words): 32-bit hashes of each text's words, texts without words
    left out."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for a, b, words in text_slices(batch.column(1)):
                h = (words.hash >> _U(32)).astype(np.uint32)
                for i in range(b - a):
                    if words.first[i + 1] > words.first[i]:
                        rows.append(a + i)
                        out.append(h[words.first[i] : words.first[i + 1]].tobytes())
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["doc", "words"])

    return docs.mapInArrow(build, "doc long, words binary")


def _slices(
    batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_WORDS
) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, a, b, words, sizes): the rows a to b of a batch, about ``most``
    words of them (a longer text alone)."""
    for batch in batches:
        texts = [np.frombuffer(w, np.uint32) for w in batch.column(column).to_pylist()]
        a = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= most or i == len(texts) - 1:
                part = texts[a : i + 1]
                yield batch, a, i + 1, np.concatenate(part), np.array([len(t) for t in part])
                a, held = i + 1, 0


def terms(words: np.ndarray) -> np.ndarray:
    return (mix(words.astype(np.uint64)) % _U(BUCKETS)).astype(np.int64)


def _pieces(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of each run of ``width`` words; a text's last run
    may be shorter."""
    count = -(-sizes // width)
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(sizes) - sizes)[text] + place * width, text


def _piece_sums(vectors: np.ndarray, t: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The sum of the terms' vectors over each run of ``width`` words.  The
    last row of ``vectors`` is zero and fills up each text's last run."""
    count = -(-sizes // width)
    shift = np.repeat((np.cumsum(count) - count) * width - (np.cumsum(sizes) - sizes), sizes)
    filled = np.full(int(count.sum()) * width, len(vectors) - 1)
    filled[np.arange(len(t)) + shift] = t
    out = np.empty((len(filled) // width, vectors.shape[1]), vectors.dtype)
    step = max(1, GATHER_WORDS // width)
    for a in range(0, len(out), step):
        rows = vectors.take(filled[a * width : (a + step) * width], axis=0)
        np.einsum("ijk->ik", rows.reshape(-1, width, vectors.shape[1]), out=out[a : a + step])
    return out


def _term_sums(latent: np.ndarray, own: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the terms among ``t``, for each the sum of ``latent`` over the passages
    ``own`` of its occurrences).  Occurrences of equally frequent terms are
    added in one step; those of frequent ones in parts of OFTEN, and the parts'
    sums likewise until there is one of each."""
    order = np.argsort(t.astype(np.uint16), kind="stable")  # linear for 16 bits
    start = np.flatnonzero(np.append(True, np.diff(t[order]) > 0))
    size, passage = np.diff(np.append(start, len(t))), own[order]
    sums = np.empty((len(start), latent.shape[1]), np.float32)
    for n in range(1, OFTEN + 1):
        k = np.flatnonzero(size == n)
        step = max(1, GATHER_WORDS // n)
        for few in (k[a : a + step] for a in range(0, len(k), step)):
            rows = latent.take((passage[start[few][:, None] + np.arange(n)]).ravel(), axis=0)
            sums[few] = np.einsum("ijk->ik", rows.reshape(len(few), n, -1))
    often = size > OFTEN
    if often.any():
        at, left = passage[np.repeat(often, size)], size[often]
        rows = latent
        while left.max() > 1:
            rows = _piece_sums(_with_zero(rows), at, left, OFTEN)
            left = -(-left // OFTEN)
            at = np.arange(len(rows))
        sums[often] = rows
    return t[order[start]], sums


def _with_zero(vectors: np.ndarray) -> np.ndarray:
    return np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)]).astype(np.float32, copy=False)


def _few_tasks(table: DataFrame) -> DataFrame:
    """``table`` in tasks of SHARED input splits, but at least two a core: each
    sends its sums for all terms, however little it has read."""
    splits, cores = table.rdd.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism
    return table.coalesce(max(2 * cores, splits // SHARED))


def term_weights(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(IDF over all passages, share of all words) of each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, words, passages = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
        for _, _, _, w, sizes in _slices(batches, 0):
            start, _ = _pieces(sizes, PASSAGE)
            own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(w))))
            t = terms(w)
            order = np.argsort(t.astype(np.uint16), kind="stable")  # linear for 16 bits
            term, passage = t[order], own[order]
            fresh = np.append(True, (term[1:] != term[:-1]) | (passage[1:] != passage[:-1]))
            found += np.bincount(term[fresh], minlength=BUCKETS)
            words += np.bincount(t, minlength=BUCKETS)
            passages += len(start)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, BUCKETS)), pa.array(np.append(found[at], passages)), pa.array(np.append(words[at], 0))],
            names=["term", "passages", "words"],
        )

    rows = _few_tasks(table.select("words")).mapInArrow(count, "term long, passages long, words long")
    got = rows.groupBy("term").agg(F.sum("passages").alias("passages"), F.sum("words").alias("words")).toArrow()
    n, words = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    n[got["term"].to_numpy()], words[got["term"].to_numpy()] = got["passages"].to_numpy(), got["words"].to_numpy()
    idf = np.log((n[BUCKETS] + 1) / (n[:BUCKETS] + 1))
    return idf.astype(np.float32), words[:BUCKETS] / max(1.0, words.sum())


def gram_times(table: DataFrame, idf: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """A'A times ``thin`` (terms by dimensions), A the TF-IDF passages."""
    width = thin.shape[1]
    weighted = _with_zero(thin * idf[:, None])
    columns = [f"x{k}" for k in range(width)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((BUCKETS, width))
        for _, _, _, w, sizes in _slices(batches, 0, SUM_WORDS):
            start, _ = _pieces(sizes, PASSAGE)
            own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(w))))
            t = terms(w)
            latent = _piece_sums(weighted, t, sizes, PASSAGE)
            at, sums = _term_sums(latent, own, t)
            out[at] += sums
        out *= idf[:, None]
        at = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), *(pa.array(out[at, k].astype(np.float32)) for k in range(width))], names=["term", *columns]
        )

    rows = _few_tasks(table.select("words")).mapInArrow(multiply, "term long, " + ", ".join(f"{c} float" for c in columns))
    got = rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out, at = np.zeros((BUCKETS, width)), got["term"].to_numpy()
    for k, c in enumerate(columns):
        out[at, k] = got[c].to_numpy()
    return out


def passage_gram(table: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(AQ)'AQ for a basis Q: the TF-IDF passages' gram matrix within it."""
    width = basis.shape[1]
    weighted = _with_zero(basis * idf[:, None])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for _, _, _, w, sizes in _slices(batches, 0):
            latent = _piece_sums(weighted, terms(w), sizes, PASSAGE)
            out += latent.T @ latent
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(out.ravel())], names=["at", "x"])

    got = _few_tasks(table.select("words")).mapInArrow(multiply, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(width * width)
    out[got["at"].to_numpy()] = got["x"].to_numpy()
    return out.reshape(width, width)


def latent_space(table: DataFrame, seed: int = 0) -> np.ndarray:
    """Terms by dimensions: the sum over a passage's words is its place in the
    whitened latent space, relative to as many words of the corpus's average.

    Randomised SVD: a Gaussian start, one pass of A'A, and a second pass
    that turns the basis to the singular vectors (Rayleigh-Ritz)."""
    idf, share = term_weights(table)
    basis = np.random.default_rng(seed).standard_normal((BUCKETS, RANK + EXTRA))
    basis, _ = np.linalg.qr(gram_times(table, idf, basis))
    values, turn = np.linalg.eigh(passage_gram(table, idf, basis))
    top = np.argsort(-values)[:RANK]
    scale = np.sqrt(np.maximum(values[top], values.max() * 1e-9 + 1e-30))
    term = (idf[:, None] * (basis @ turn[:, top]) / scale).astype(np.float32)
    return term - (share @ term).astype(np.float32)


class Items(NamedTuple):
    """A block of benchmark items: ids, word hashes, the number of words of
    the answer at each end, and the length of the windows to compare with (in
    steps of the grid)."""

    ids: list
    words: list[np.ndarray]
    answer: list[int]
    steps: np.ndarray
    latent: np.ndarray


def _answer_words(text: str) -> int:
    """Words of the last sentence or line."""
    parts = [p for p in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|\n", text.strip()) if p.strip()]
    return len(re.findall(r"[^\x20\x09-\x0D]+", parts[-1])) if parts else 0


def prepare_items(rows: list[tuple], space: np.ndarray) -> Items:
    ids, words, answer = [], [], []
    for key, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        found = split(raw, np.array([0, len(raw)]))
        if len(found.hash):
            ids.append(key)
            words.append((found.hash >> _U(32)).astype(np.uint32))
            answer.append(_answer_words(text))
    steps = np.array([-(-(len(w) + GRID - 1) // GRID) for w in words], dtype=np.int64)
    latent = np.array([space[terms(w)].sum(axis=0) for w in words], dtype=np.float32)
    latent = latent.reshape(len(words), space.shape[1])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Items(ids, words, answer, steps, latent)


def subsequence_masks(item: np.ndarray) -> dict[int, int]:
    """For each word of an item the bits of its places."""
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(masks: dict[int, int], size: int, window: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each item word."""
    full = (1 << size) - 1
    v = full
    for m in map(masks.get, window):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Verifier:
    """The checks of a candidate window, for one block of items."""

    def __init__(self, items: Items, cover: float, paraphrase: float):
        self.items, self.cover, self.paraphrase = items, cover, paraphrase
        self.masks = [subsequence_masks(w) for w in items.words]
        self.answers = [subsequence_masks(w[len(w) - n :]) for w, n in zip(items.words, items.answer, strict=True)]
        self.size = np.array([len(w) for w in items.words])
        self.floor = np.where(self.size < MIN_WORDS, self.size, np.ceil(self.size * min(cover, paraphrase) - 1e-9)).astype(np.int64)
        self.vocabulary = np.unique(np.concatenate(items.words))
        self.maybe = np.zeros(1 << 20, dtype=bool)  # by the lowest bits of a word
        self.maybe[self.vocabulary & np.uint32(len(self.maybe) - 1)] = True

    def places(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the items' vocabulary, one past its end for
        other words."""
        out = np.full(len(words), len(self.vocabulary))
        some = np.flatnonzero(self.maybe[words & np.uint32(len(self.maybe) - 1)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == words[some]
        out[some[hit]] = at[hit]
        return out

    def holds(self, own: np.ndarray) -> np.ndarray:
        """(vocabulary and a last row of zeros) by the items ``own``: whether
        the item has the word."""
        out = np.zeros((len(self.vocabulary) + 1, len(own)), np.uint8)
        for k, i in enumerate(own.tolist()):
            out[np.searchsorted(self.vocabulary, self.items.words[i]), k] = 1
        return out

    def verdict(self, item: int, window: list[int]) -> tuple[float, float] | None:
        """(share of the item's words, of its answer's) if it is a leak."""
        size = int(self.size[item])
        whole = common_subsequence(self.masks[item], size, window) / size
        if whole < min(self.cover, self.paraphrase):
            return None
        n = self.items.answer[item]
        answer = common_subsequence(self.answers[item], n, window) / n if n else 0.0
        if size < MIN_WORDS:
            return (whole, answer) if whole == 1 else None
        if whole >= self.cover or (whole >= self.paraphrase and answer >= self.cover):
            return whole, answer
        return None


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_cosine: float = 0.25,
    cover: float = 0.8,
    paraphrase: float = 0.6,
) -> DataFrame:
    """(doc, item, cosine, cover, answer, at): one row for each document and
    benchmark item found in it, with the best window's cosine, the shares of
    the item's and of its answer's words in common order, and the window's
    first word.  A leak has ``cover`` of the item's words in order, or
    ``paraphrase`` of them and ``cover`` of the answer's."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    table = materialise(word_table(texts))
    space = latent_space(table)
    release(docs.sparkSession)
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{item_text_col}`")).distinct()
    found, block = [], []
    for row in rows.toLocalIterator():
        block.append(tuple(row))
        if len(block) == ITEM_BLOCK:
            found.append(_search(table, space, prepare_items(block, space), min_cosine, cover, paraphrase))
            block = []
    found.append(_search(table, space, prepare_items(block, space), min_cosine, cover, paraphrase))
    best = F.max(F.struct("cover", "answer", "cosine", (-F.col("at")).alias("before"))).alias("best")
    return (
        reduce(DataFrame.union, found)
        .groupBy("doc", "item")
        .agg(best)
        .select("doc", "item", "best.cosine", "best.cover", "best.answer", (-F.col("best.before")).alias("at"))
    )


def _search(
    table: DataFrame, space: np.ndarray, items: Items, min_cosine: float, cover: float, paraphrase: float
) -> DataFrame:
    schema = "doc long, item long, cosine double, cover double, answer double, at long"
    if not items.ids:
        return table.sparkSession.createDataFrame([], schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier, vectors = Verifier(items, cover, paraphrase), _with_zero(space)
        by_steps = [(int(s), np.flatnonzero(items.steps == s)) for s in np.unique(items.steps)]
        order = np.concatenate([own for _, own in by_steps])
        holds, floor = verifier.holds(order), verifier.floor[order]
        # differences of sums are right however often the sums ran over, as long
        # as a window's words fit in
        count = np.min_scalar_type(by_steps[-1][0] * GRID)
        for batch, a, b, words, sizes in _slices(batches, 1):
            ids = batch.column(0).slice(a, b - a).to_pylist()
            cells, text = _pieces(sizes, GRID)
            sums = np.zeros((len(cells) + 1, space.shape[1]), np.float32)
            np.cumsum(_piece_sums(vectors, terms(words), sizes, GRID), axis=0, out=sums[1:])
            last = np.cumsum(np.bincount(text, minlength=len(sizes)))  # one past each text's cells
            bounds = np.append(cells, len(words))
            # no common subsequence is longer than the number of the window's
            # words that are words of the item
            held = np.zeros((len(cells) + 1, len(order)), count)
            np.cumsum(_piece_sums(holds, verifier.places(words), sizes, GRID), axis=0, out=held[1:])
            out, done = [], 0
            for steps, own in by_steps:
                start, end, real = _windows(text, last, steps)
                z = _differences(sums, start, end, steps)
                cosine = z @ items.latent[own].T
                norm = np.sqrt(np.einsum("ij,ij->i", z, z))
                part = slice(done, done + len(own))
                near = _differences(held[:, part], start, end, steps) >= floor[part].astype(count)
                near &= cosine >= min_cosine * np.maximum(norm, 1e-12)[:, None]
                near &= real[:, None]
                w, i = np.divmod(np.flatnonzero(near), len(own))  # faster than nonzero
                done += len(own)
                item, lo, hi = own[i], bounds[start[w]], bounds[end[w]]
                for c in range(len(w)):
                    shares = verifier.verdict(int(item[c]), words[lo[c] : hi[c]].tolist())
                    if shares:
                        t = int(text[start[w[c]]])
                        first = int(lo[c] - (cells[last[t - 1]] if t else 0))
                        out.append((ids[t], items.ids[item[c]], float(cosine[w[c], i[c]] / norm[w[c]]), *shares, first))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()], strict=True)],
                    names=["doc", "item", "cosine", "cover", "answer", "at"],
                )

    return table.select("doc", "words").mapInArrow(search, schema)


def _windows(text: np.ndarray, last: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first cell, one past the last, whether it lies in one text) of the runs
    of ``steps`` cells from the first on, and after these of each text of fewer
    cells, which is one window."""
    at = np.arange(max(0, len(text) - steps + 1))
    first = np.append(0, last[:-1])
    short = np.flatnonzero((last - first < steps) & (last > first))
    real = np.append(text[at] == text[at + steps - 1], np.ones(len(short), bool))
    return np.append(at, first[short]), np.append(at + steps, last[short]), real


def _differences(sums: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int) -> np.ndarray:
    """``sums`` at the ends of windows less those at their starts."""
    out = np.empty((len(start), sums.shape[1]), sums.dtype)
    runs = max(0, len(sums) - steps)
    np.subtract(sums[steps:], sums[:runs], out=out[:runs])
    out[runs:] = sums[end[runs:]] - sums[start[runs:]]
    return out
