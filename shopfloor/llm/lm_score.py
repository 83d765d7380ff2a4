"""LM scoring with a hashed maximum-entropy model.

A token's probability is P(group | context) * P(class | group, context) *
P(word | class).  A word's class comes from a hash: of the whole word if it is
short, else of its beginning and end, so that classes follow spelling and need
no table.  The first two factors are softmax models over hashed features of
the context: the word before (n-gram), the classes of the three words before
(the second and third skip what lies between) and the pair of the two classes
before.  These weights are few and only the prior: what single words before
tell is counted by (feature, class) over all training texts, features being
the word before and the word before that, and mixed with the prior as
``PRIOR`` imagined occurrences.  The last factor is the maximum-entropy model with one feature a word,
whose solution is closed: counts with absolute discounting, the discounted
mass being that of words not seen in the class.

Training is distributed: documents are tokenised once into chunks (a
dictionary and codes) in the shared folder; in each round every task follows
the gradient over its chunks from the shared weights, and Spark sums the
weights' changes, each weighted by how often its feature occurred.  Word
counts are grouped by word and joined back to the chunks that hold the word,
so that no task and no broadcast holds the vocabulary.  Feature counts are a
table in blocks by ranges of the feature's hash; a block adds up what all
chunks have of its range and answers each with the sums, in the chunk's own
order.  The driver holds the weights (a fixed number) and sums by class.

Words are told apart by 64-bit hashes.

Defined cases: a null text is an empty text and has one token, its end; a null
id is in training; repeated rows count as often as they occur; without
training documents every base score is 0 and every word is unknown; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.tables import discard, materialise, release, scratch
from shopfloor.llm.words import FOLD, Words, mix, text_slices

_U = np.uint64
GROUPS, MEMBERS = 16, 16
CLASSES = GROUPS * MEMBERS
#: Longer words (in bytes) get their class from their beginning and end.
SHORT_WORD = 4
#: The end of a text, a token of its own.
END = _U(1)
#: Feature rows: one always on, words before, classes 1 to 3 before, pairs.
WORD_ROWS, PAIR_ROWS = 1024, 256
AT_WORD = 1
AT_CLASS = AT_WORD + WORD_ROWS
AT_PAIR = AT_CLASS + 3 * CLASSES
ROWS = AT_PAIR + PAIR_ROWS
FEATURES = 6
#: Tokens that share one step along the gradient, and that are scored at once.
BATCH = 8192
#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 6 << 20
RATE = 0.25
#: Distances of the words before that are features with the class.
BEFORE = (2, 1)
PRIOR = 64.0
#: Chunks whose features make up one block of the feature table.
BLOCK_CHUNKS = 1
#: Blocks that a chunk sends at once.
SENT_BLOCKS = 4
#: Keys of a block that are added up at once.
ADD_KEYS = 1 << 18


def word_classes(words: Words) -> np.ndarray:
    """The class (0 to 255) of each word, from its spelling alone."""
    raw = FOLD[words.raw]
    size = words.end - words.start
    a, b = raw[words.start].astype(np.uint64), raw[np.minimum(words.start + 1, words.end - 1)].astype(np.uint64)
    y, z = raw[np.maximum(words.end - 2, words.start)].astype(np.uint64), raw[words.end - 1].astype(np.uint64)
    whole = mix(words.hash) % _U(CLASSES // 2) + _U(CLASSES // 2)
    head = mix(a * _U(256) + b) % _U(GROUPS // 2)
    tail = mix(y * _U(256) + z + _U(1 << 20)) % _U(MEMBERS)
    return np.where(size <= SHORT_WORD, whole, head * _U(MEMBERS) + tail).astype(np.uint8)


END_CLASS = np.uint8(int(mix(np.array([END]))[0]) % (CLASSES // 2) + CLASSES // 2)


def chunk_table(docs: DataFrame) -> DataFrame:
    """Chunks of (id, held, text): ids, held, sizes (tokens with the end),
    codes into the chunk's own dictionary, and per dictionary entry its hash,
    class and count in training texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held_parts: list[tuple] = []
            size = 0
            for a, b, words in text_slices(batch.column(2)):
                held_parts.append((a, b, words.hash, word_classes(words), words.first))
                size += len(words.raw)
                if size >= CHUNK_BYTES:
                    yield _chunk(batch, held_parts)
                    held_parts, size = [], 0
            if held_parts:
                yield _chunk(batch, held_parts)

    return docs.mapInArrow(
        build, "ids array<long>, held array<boolean>, sizes array<int>, codes binary, hashes binary, classes binary, counts binary"
    ).withColumn("chunk", F.monotonically_increasing_id())


def _chunk(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
    lo, hi = parts[0][0], parts[-1][1]
    hashes, classes, sizes = [], [], []
    for _, _, h, c, first in parts:
        # the end token after the words of each text
        hashes.append(np.insert(h, first[1:], END))
        classes.append(np.insert(c, first[1:], END_CLASS))
        sizes.append(np.diff(first) + 1)
    h, c, size = np.concatenate(hashes), np.concatenate(classes), np.concatenate(sizes)
    known, at, codes = np.unique(h, return_index=True, return_inverse=True)
    often = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")  # small codes for frequent words
    place = np.empty_like(often)
    place[often] = np.arange(len(often))
    known, at, codes = known[often], at[often], place[codes]
    held = batch.column(1).slice(lo, hi - lo)
    trains = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), size)
    counts = np.bincount(codes[trains], minlength=len(known)).astype(np.int32)
    one = lambda x, kind: pa.array([x], kind)
    return pa.RecordBatch.from_arrays(
        [
            one(batch.column(0).slice(lo, hi - lo).to_pylist(), pa.list_(pa.int64())),
            one(held.to_pylist(), pa.list_(pa.bool_())),
            one(size, pa.list_(pa.int32())),
            one(_planes(codes), pa.binary()),
            one(known.tobytes(), pa.binary()),
            one(c[at].tobytes(), pa.binary()),
            one(counts.tobytes(), pa.binary()),
        ],
        names=["ids", "held", "sizes", "codes", "hashes", "classes", "counts"],
    )


def _planes(codes: np.ndarray) -> bytes:
    """Codes as bytes, all lowest bytes first: the high ones, mostly zero,
    then lie together and compress to little."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def entry_rows(chunks: DataFrame) -> DataFrame:
    """(chunk, at, h, class, c): each chunk's dictionary."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, h, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h = np.frombuffer(h, np.int64)
                for a in range(0, len(h), 50_000):
                    part = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(h[part]), chunk)),
                            pa.array(np.arange(a, a + len(h[part]))),
                            pa.array(h[part]),
                            pa.array(np.frombuffer(k, np.uint8)[part].astype(np.int16)),
                            pa.array(np.frombuffer(c, np.int32)[part].astype(np.int64)),
                        ],
                        names=["chunk", "at", "h", "class", "c"],
                    )

    return chunks.select("chunk", "hashes", "classes", "counts").mapInArrow(emit, "chunk long, at long, h long, class short, c long")


@dataclass
class Model:
    """Weights and the sums by class that make up the model."""

    groups: np.ndarray  # ROWS x GROUPS
    members: np.ndarray  # (ROWS * GROUPS) x MEMBERS
    tokens: np.ndarray  # training tokens of each class
    words: np.ndarray  # distinct training words of each class
    discount: np.ndarray
    total: int
    distinct: int


def start_model(sums: pd.DataFrame) -> Model:
    """The model before training: no context, only how often classes are."""
    tokens, words, once, twice = (np.zeros(CLASSES) for _ in range(4))
    at = sums["class"].to_numpy().astype(int)
    tokens[at], words[at], once[at], twice[at] = (sums[c].to_numpy() for c in ("tokens", "words", "once", "twice"))
    discount = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.9)
    share = (tokens + 0.5).reshape(GROUPS, MEMBERS)
    groups = np.zeros((ROWS, GROUPS), np.float32)
    members = np.zeros((ROWS * GROUPS, MEMBERS), np.float32)
    groups[0] = np.log(share.sum(axis=1) / share.sum())
    members[:GROUPS] = np.log(share / share.sum(axis=1, keepdims=True))
    return Model(groups, members, tokens, words, discount, int(tokens.sum()), int(words.sum()))


def context(codes: np.ndarray, sizes: np.ndarray, h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(tokens, FEATURES) feature rows of every token's context; before a
    text's first word stands the end of a text."""
    word_row = (mix(h) % _U(WORD_ROWS)).astype(np.int32)
    end_row = np.int32(int(mix(np.array([END]))[0]) % WORD_ROWS)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(codes), FEATURES), dtype=np.int32)
    out[1:, 1] = word_row[codes[:-1]]
    out[place == 0, 1] = end_row
    out[:, 1] += AT_WORD
    own = classes[codes].astype(np.int32)
    for k in (1, 2, 3):
        out[k:, 1 + k] = own[:-k]
        out[place < k, 1 + k] = END_CLASS
    pair = mix((out[:, 2] * CLASSES + out[:, 3]).astype(np.uint64)) % _U(PAIR_ROWS)
    for k in (1, 2, 3):
        out[:, 1 + k] += AT_CLASS + (k - 1) * CLASSES
    out[:, 5] = AT_PAIR + pair.astype(np.int32)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """The softmax of each row of ``z``, as columns: sums of whole rows are
    several times faster than sums of 16 numbers."""
    z = np.ascontiguousarray(z.T)
    z -= z.max(axis=0)
    np.exp(z, out=z)
    parts = z
    while len(parts) > 1:  # halves, then neighbours: the order of a row's own sum
        parts = parts[:8] + parts[8:] if len(parts) == 16 else parts[::2] + parts[1::2]
    z /= parts
    return z


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += weights.take(rows[:, k], axis=0)
    return z


def class_probability(model: Model, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 P(class | context) of each token."""
    out = np.empty(len(classes))
    for a in range(0, len(classes), BATCH):
        f, k = rows[a : a + BATCH], classes[a : a + BATCH].astype(np.int64)
        i, g = np.arange(len(k)), k // MEMBERS
        p = _softmax(_logits(model.groups, f))[g, i]
        q = _softmax(_logits(model.members, f * GROUPS + g[:, None]))[k % MEMBERS, i]
        out[a : a + BATCH] = np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(q, 1e-30))
    return out


class Trainer:
    """Follows the gradient from given weights, with a step for each weight
    that shrinks as its gradients add up."""

    def __init__(self, model: Model):
        self.weights = [model.groups.copy(), model.members.copy()]
        self.begin = [w.copy() for w in self.weights]
        self.power = [np.full(w.shape, 1e-6, np.float32) for w in self.weights]
        self.seen = [np.zeros(len(w)) for w in self.weights]

    def _step(self, which: int, rows: np.ndarray, target: np.ndarray) -> None:
        w, n = self.weights[which], len(rows)
        error = _softmax(_logits(w, rows))
        error[target, np.arange(n)] -= 1
        times = np.bincount(rows.ravel(), minlength=len(w))
        used = np.flatnonzero(times)
        place = np.zeros(len(w), np.int64)
        place[used] = np.arange(len(used))
        gradient = np.empty((len(used), w.shape[1]), np.float32)
        # every feature has rows of its own, and its used ones lie together
        errors = error.astype(np.float64)
        for f in range(rows.shape[1]):
            at = place[rows[:, f]]
            low = int(at.min())
            at -= low
            size = int(at.max()) + 1
            for k in range(w.shape[1]):
                gradient[low : low + size, k] = np.bincount(at, weights=errors[k], minlength=size)
        gradient /= n
        power = self.power[which].take(used, axis=0) + gradient * gradient
        self.power[which][used] = power
        w[used] -= RATE * gradient / np.sqrt(power)
        self.seen[which] += times

    def learn(self, rows: np.ndarray, classes: np.ndarray) -> None:
        for a in range(0, len(classes), BATCH):
            f, k = rows[a : a + BATCH], classes[a : a + BATCH].astype(np.int64)
            self._step(0, f, k // MEMBERS)
            self._step(1, f * GROUPS + (k // MEMBERS)[:, None], k % MEMBERS)

    def changes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, times seen, change) of the rows that occurred; rows of the
        second model come after those of the first."""
        seen = np.concatenate(self.seen)
        change = np.concatenate([w - b for w, b in zip(self.weights, self.begin, strict=True)])
        at = np.flatnonzero(seen)
        return at, seen[at], change[at]


def train_round(chunks: DataFrame, model: Model, part: int, parts: int) -> Model:
    """The model after one round over the training texts of the chunks whose
    number is ``part`` modulo ``parts``."""
    width = GROUPS
    columns = [f"x{k}" for k in range(width)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(model)
        for batch in batches:
            for i in range(batch.num_rows):
                held, sizes, codes, h, classes = _arrays(batch, i)
                keep = np.repeat(~held, sizes)
                rows = context(codes, sizes, h, classes)[keep]
                trainer.learn(rows, classes[codes[keep]])
        at, seen, change = trainer.changes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(seen), *(pa.array((change[:, k] * seen).astype(np.float64)) for k in range(width))],
            names=["row", "seen", *columns],
        )

    own = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(parts)) == part).select("held", "sizes", "codes", "hashes", "classes")
    changed = own.mapInArrow(learn, "row long, seen double, " + ", ".join(f"{c} double" for c in columns))
    summed = changed.groupBy("row").agg(F.sum("seen").alias("seen"), *[F.sum(c).alias(c) for c in columns]).toPandas()
    at = summed["row"].to_numpy()
    change = np.zeros((ROWS + ROWS * GROUPS, width))
    change[at] = summed[columns].to_numpy() / summed[["seen"]].to_numpy()
    return Model(
        (model.groups + change[:ROWS]).astype(np.float32),
        (model.members + change[ROWS:]).astype(np.float32),
        model.tokens, model.words, model.discount, model.total, model.distinct,
    )


def _arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """held, sizes, codes, hashes and classes of row i."""
    get = lambda name: batch.column(name)[i]
    return (
        np.array(get("held").as_py(), dtype=bool),
        np.array(get("sizes").as_py(), dtype=np.int64),
        _from_planes(get("codes").as_py()),
        np.frombuffer(get("hashes").as_py(), np.uint64),
        np.frombuffer(get("classes").as_py(), np.uint8),
    )


def feature_keys(
    codes: np.ndarray, sizes: np.ndarray, h: np.ndarray, classes: np.ndarray
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(keys, places): the sorted 64-bit keys of a chunk's features, alone and
    with the class that follows, and for each distance of BEFORE the places of
    every token's (feature, class) and feature."""
    # half as wide where a chunk's numbers allow it, as they do but for one of
    # millions of words
    kind = np.int32 if max(len(h) + 1, len(codes)) < 1 << 22 else np.int64
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(kind)
    known, own = np.append(h, END), classes[codes].astype(kind)
    keys, places, size = [], [], 0
    for k in BEFORE:
        before = np.full(len(codes), len(h), kind)
        before[k:] = codes[:-k]
        before[place < k] = len(h)
        # by hash, as the keys are sorted below anyway
        both = pa.array(before * kind(512) + own).dictionary_encode()
        # class 0 to 255, and 256 for the feature alone
        alone = np.flatnonzero(np.bincount(before, minlength=len(known)))
        number = np.zeros(len(known), kind)
        number[alone] = np.arange(len(alone))
        for used, at in ((both.dictionary.to_numpy(), both.indices.to_numpy()), (alone * 512 + CLASSES, number[before])):
            places.append((at + size).astype(kind))
            size += len(used)
            used = used.astype(np.int64)
            feature = mix(known[used >> 9] + _U(k << 40))
            keys.append(mix(feature + (used & 511).astype(np.uint64)))
        del both, at
    del place, own, before
    both = np.concatenate(keys)
    order = np.argsort(both)
    rank = np.empty(len(order), kind)
    rank[order] = np.arange(len(order))
    places = [rank[a] for a in places]
    return both[order], list(zip(places[::2], places[1::2], strict=True))


def _wide(x: np.ndarray) -> bytes:
    """64-bit numbers as bytes, all lowest bytes first."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_wide(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _packed(data: bytes) -> bytes:
    """Compressed, after its size: planes of small numbers take bits, which the
    fast compression of shuffle files leaves as bytes."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes | pa.Buffer) -> pa.Buffer:
    view = memoryview(data)
    return pa.decompress(view[8:], decompressed_size=int.from_bytes(view[:8], "little"), codec="zstd")


def _buffers(column: pa.ChunkedArray) -> list[pa.Buffer]:
    return [x.as_buffer() for chunk in column.chunks for x in chunk]


def add_counts(keys: list, counts: list) -> list[bytes]:
    """For each of several sorted sets of keys (differences, not empty) with
    their counts: the sums of its keys' counts over all sets.  The keys are
    gone through by ranges of about ADD_KEYS, so that beside what comes and
    goes only a range is in memory at a time."""
    keys = [np.cumsum(_from_wide(k).view(np.uint64), dtype=np.uint64) for k in keys]
    planes = [np.frombuffer(c, np.uint8).reshape(8, -1) for c in counts]
    out = [np.empty_like(p) for p in planes]
    low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
    parts = 1 + sum(map(len, keys)) // ADD_KEYS
    edges = np.array([low + (high - low + 1) * i // parts for i in range(1, parts)], dtype=np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]) for k in keys]
    for i in range(parts):
        own = [slice(c[i], c[i + 1]) for c in cuts]
        known, at = np.unique(np.concatenate([k[x] for k, x in zip(keys, own, strict=True)]), return_inverse=True)
        sums = np.zeros(len(known), np.int64)
        np.add.at(sums, at, np.concatenate([_from_wide(p[:, x].tobytes()) for p, x in zip(planes, own, strict=True)]))
        sums, first = sums[at], 0
        for o, x in zip(out, own, strict=True):
            size = x.stop - x.start
            o[:, x] = sums[first : first + size].astype("<i8").view(np.uint8).reshape(-1, 8).T
            first += size
    return [o.tobytes() for o in out]


def feature_counts(chunks: DataFrame) -> DataFrame:
    """(chunk, block, counts): the training counts in all chunks of each
    chunk's features, in the order of their keys, by ranges of the keys."""
    blocks = 1 + chunks.count() // BLOCK_CHUNKS
    edges = np.array([k * (1 << 64) // blocks for k in range(1, blocks)], dtype=np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, sizes, codes, h, classes = _arrays(batch, i)
                keys, places = feature_keys(codes, sizes, h, classes)
                trains = np.repeat(~held, sizes)
                counts = np.zeros(len(keys), np.int64)
                for pair in places:
                    for at in pair:
                        counts += np.bincount(at[trains], minlength=len(keys))
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                own = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                chunk = batch.column("chunk")[i].as_py()
                for few in (own[a : a + SENT_BLOCKS] for a in range(0, len(own), SENT_BLOCKS)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chunk] * len(few), pa.int64()),
                            pa.array([k for k, _ in few], pa.int32()),
                            # sorted keys lie close together, so that their differences have empty planes
                            pa.array([_packed(_wide(np.diff(keys[part], prepend=_U(0)))) for _, part in few], pa.binary()),
                            pa.array([_packed(_wide(counts[part])) for _, part in few], pa.binary()),
                        ],
                        names=["chunk", "block", "keys", "counts"],
                    )

    def add(block: pa.Table) -> pa.Table:
        keys, counts = (list(map(_unpacked, _buffers(block[c]))) for c in ("keys", "counts"))
        sums = pa.array(add_counts(keys, counts), pa.binary())
        return pa.table({"chunk": block["chunk"], "block": block["block"], "counts": sums})

    rows = chunks.select("chunk", "held", "sizes", "codes", "hashes", "classes").mapInArrow(
        emit, "chunk long, block int, keys binary, counts binary"
    )
    return rows.groupBy("block").applyInArrow(add, "chunk long, block int, counts binary")


def score_texts(
    model: Model, sizes: np.ndarray, codes: np.ndarray, h: np.ndarray, classes: np.ndarray, counts: np.ndarray, features: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each text of a chunk; ``counts``
    holds the whole corpus's training count of each dictionary entry and
    ``features`` that of each of the chunk's features."""
    first = np.cumsum(sizes) - sizes
    base = np.log10(counts + 0.5) - np.log10(model.total + 0.5 * (model.distinct + 1))
    k = classes.astype(np.int64)
    mass, left = model.tokens[k], model.discount[k] * model.words[k]
    seen = counts > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(seen, (counts - model.discount[k]) / mass, np.where(mass > 0, left / mass, 1.0))
    own = np.log10(share)
    p = 10 ** class_probability(model, context(codes, sizes, h, classes), classes[codes])
    for with_class, alone in feature_keys(codes, sizes, h, classes)[1]:
        p = (features[with_class] + PRIOR * p) / (features[alone] + PRIOR)
    total = own[codes] + np.log10(p)
    add = lambda x: np.add.reduceat(x, first)
    return add(seen[codes].astype(np.int64)), add(base[codes]), add(total)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    each row.  Texts whose id's CRC-32 modulo 5 is 1 are held out; the others
    are learned from, each in one of ``rounds`` rounds."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    chunks = materialise(
        chunk_table(
            docs.select(
                F.col(f"`{id_col}`").cast("long").alias("doc"),
                (F.crc32(F.encode(key, "UTF-8")) % 5 == 1).alias("held"),
                F.col(f"`{text_col}`").alias("text"),
            )
        )
    )
    entries = entry_rows(chunks)
    work = scratch(docs.sparkSession)
    counted = materialise(
        entries.groupBy("h").agg(F.sum("c").alias("c"), F.first("class").alias("class"), F.count(F.lit(1)).alias("chunks")), work
    )
    sums = counted.where(F.col("c") > 0).groupBy("class").agg(
        F.sum("c").alias("tokens"),
        F.count(F.lit(1)).alias("words"),
        F.count_if(F.col("c") == 1).alias("once"),
        F.count_if(F.col("c") == 2).alias("twice"),
    )
    model = start_model(sums.toPandas())  # one row a class
    for part in range(rounds):
        model = train_round(chunks, model, part, rounds)
        release(docs.sparkSession)
    features = materialise(feature_counts(chunks))
    release(docs.sparkSession)

    # counts of the words that other chunks hold too; of the rest each chunk
    # has the count itself
    wide = counted.where(F.col("chunks") > 1).select("h", F.col("c").alias("all"))
    told = materialise(entries.select("chunk", "at", "h").join(wide, "h").select("chunk", "at", "all"))
    release(docs.sparkSession)
    discard(docs.sparkSession, work)
    told = told.unionByName(features, allowMissingColumns=True)

    def score(key, chunk: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        blocks = words.filter(pc.is_valid(words["block"])).sort_by("block")
        words = words.filter(pc.is_null(words["block"]))
        features = np.concatenate([np.zeros(0, np.int64), *(_from_wide(c) for c in blocks["counts"].to_pylist())])
        for batch in chunk.to_batches():
            for i in range(batch.num_rows):
                held, sizes, codes, h, classes = _arrays(batch, i)
                counts = np.frombuffer(batch.column("counts")[i].as_py(), np.int32).astype(np.int64)
                if words.num_rows:
                    counts[words["at"].to_numpy()] = words["all"].to_numpy()
                known, base, own = score_texts(model, sizes, codes, h, classes, counts, features)
                out.append(
                    pa.table(
                        {
                            "doc": pa.array(batch.column("ids")[i].as_py(), pa.int64()),
                            "held_out": pa.array(held),
                            "n_tokens": pa.array(sizes),
                            "n_known": pa.array(known),
                            "train_tokens": pa.array(np.full(len(sizes), model.total)),
                            "base_score": pa.array(base),
                            "score": pa.array(own),
                        }
                    )
                )
        return pa.concat_tables(out)

    schema = "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    whole = chunks.select(F.col("chunk").alias("key"), "ids", "held", "sizes", "codes", "hashes", "classes", "counts")
    return whole.groupBy("key").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)
