"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles.  For a band of set sizes the
hash space is cut into m equal pieces, and the shingles of each piece are
XORed into one sketch word.  Sets with Jaccard similarity of at least the
threshold differ in at most D shingles, where D follows from the sizes; each
difference touches one piece, so with m = D + 1 + s pieces at least s + 1 are
untouched and their words are equal (pigeonhole).  A set leaves out its s
pieces with the fewest shingles, which unrelated sets may share by chance (the
earlier ones first where they have equally many): equal pieces hold equally
many, so the last of the equal words in this order has s equal ones before it
and neither set leaves it out.  Sets that share a word are candidates; they
are compared by the Hamming distance
of their bit sketches (one bit flipped a shingle), which is a lower bound of
their symmetric difference, and what remains is verified on the sets.

Equal sets are one vertex, so copies are never paired.  A word that only a few
sets share gives their pairs; of one that many share each set is first paired
with the word's least set only, and words whose sets these pairs connect are
done with.  The others go through ``_span``: in blocks, pairs within the
Hamming bound are taken only between sets that the pairs taken so far do not
connect.  If a taken pair fails verification and nothing else connects the
two, its word is gone through again from the components found, taking more
pairs between two groups each time, until no group is taken for connected that
is not: every component is exact, though not every link is listed.

Nothing is dropped or capped; the driver sees counts only.

Defined cases: a null or wordless text has the empty set and links with
nothing; a text shorter than a shingle has one, its whole sequence; rows that
repeat a doc_id are one document with the links of all its texts; a null
doc_id links with nothing and has a null component; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.components import components
from shopfloor.llm.tables import discard, materialise, release, scratch
from shopfloor.llm.words import mix, shingles, text_slices

_U = np.uint64
#: Words shared by more sets than this are gone through in blocks.
FEW = 8
BLOCK = 4096
#: Pairs between two groups of a word's sets that are verified, if there are so
#: many, before the groups are taken for connected.
REACH = 8
#: Bits of a sketch for each piece that is not spare.
BITS = 16
#: Sets whose words a task remembers having sent already.
SEEN = 1_000_000
#: Pairs whose texts a task holds at once.
VERIFIED = 256
BAND_RATIO = (3, 2)
#: The low bits of a join key that hold its join band (some 70 bands).
BAND_BITS = 7


class Bands:
    """Size bands for a threshold of ``percent`` / 100.

    Join band j holds the sizes of band j and those below that can still link
    with one of them.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * BAND_RATIO[0] // BAND_RATIO[1]))

    def differ(self, s: int, t: int) -> int:
        """The largest symmetric difference of linked sets of these sizes:
        100 * both >= percent * all and s + t = both + all."""
        return (100 - self.percent) * (s + t) // (100 + self.percent)

    def own(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def of(self, n: int) -> list[int]:
        """The join bands that a set of size n takes part in."""
        j = self.own(n)
        return [j, j + 1] if 100 * n >= self.percent * self.edges[j + 1] else [j]

    def pieces(self, j: int) -> tuple[int, int]:
        """(pieces, spare) of a join band."""
        top = self.edges[j + 1] - 1
        least = self.differ(top, top) + 1
        spare = 2 + least // 4 if least > 1 else 0
        return least + spare, spare

    def linked(self, both: int, s: int, t: int) -> bool:
        return 100 * both >= self.percent * (s + t - both)


@lru_cache(maxsize=4)
def bands_for(percent: int) -> Bands:
    return Bands(percent)


@lru_cache(maxsize=4096)
def _cuts(m: int) -> np.ndarray:
    return np.array([(k << 64) // m for k in range(m)], dtype=np.uint64)


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    a = np.array([own.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own + _U(0x9E3779B97F4A7C15)))])
    a = mix(a + _U(len(own))).astype(np.int64).tolist()
    return a[0], a[1]


def sketch_words(own: np.ndarray, j: int, bands: Bands) -> np.ndarray:
    """The join keys of a sorted set in join band j, which their low bits tell."""
    m, spare = bands.pieces(j)
    at = np.searchsorted(own, _cuts(m))
    size = np.diff(np.append(at, len(own)))
    full = np.flatnonzero(size)
    word = np.zeros(m, dtype=np.uint64)
    word[full] = np.bitwise_xor.reduceat(mix(own ^ _U(0x5851F42D4C957F2D)), at[full])
    piece = np.argsort(size, kind="stable")[spare:]
    key = mix(word[piece] + mix(piece.astype(np.uint64) + _U(j) * _U(0x100000001B3) + _U(1)))
    return key >> _U(BAND_BITS) << _U(BAND_BITS) | _U(j)


def bit_sketch(own: np.ndarray, j: int, bands: Bands) -> bytes:
    """One bit flipped for each shingle, BITS to a piece that is not spare, in
    whole 64-bit words."""
    m, spare = bands.pieces(j)
    bits = -(-BITS * (m - spare) // 64) * 64
    flips = np.bincount((mix(own) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set) of each text that has words."""
    for a, b, words in text_slices(column):
        h, first = shingles(words, width)
        for i in range(b - a):
            if first[i + 1] > first[i]:
                own = np.sort(h[first[i] : first[i + 1]])
                if len(own) > 1:
                    own = own[np.append(True, own[1:] != own[:-1])]
                yield a + i, own


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc, n, h1, h2) of each row of ``docs`` (doc, text)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, own in _sets(batch.column(1), width):
                n[i] = len(own)
                h1[i], h2[i] = set_key(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, h1, h2))], names=["doc", "n", "h1", "h2"])

    return docs.mapInArrow(describe, "doc long, n long, h1 long, h2 long")


def word_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(k, h1): every join key with the set that has it; copies that one task
    meets send theirs once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = bands_for(percent), set()
        for batch in batches:
            keys, owner, held = [], [], 0
            for _, own in _sets(batch.column(1), width):
                h1 = set_key(own)[0]
                if h1 in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h1)
                for j in bands.of(len(own)):
                    keys.append(sketch_words(own, j, bands))
                    owner.append(np.full(len(keys[-1]), h1))
                    held += len(keys[-1])
                if held > 500_000:
                    yield _pair_batch(keys, owner)
                    keys, owner, held = [], [], 0
            if keys:
                yield _pair_batch(keys, owner)

    return docs.mapInArrow(emit, "k long, h1 long")


def _pair_batch(keys: list[np.ndarray], owner: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(owner))], names=["k", "h1"]
    )


def shared_words(rows: DataFrame) -> DataFrame:
    """(many, k, a, b) from (k, h1): the pairs of sets that share a word with
    at most FEW sets, and each set (b) of a word that more share, with the
    least of them (a).  Rows of a word lie together and in order, so that they
    are read as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = h = np.zeros(0, np.int64)
        crowded = None  # the key that runs on and its least set, if rows of it are out
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.concatenate([k, batch.column(0).to_numpy()])
            h = np.concatenate([h, batch.column(1).to_numpy()])
            fresh = np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1]))
            k, h = k[fresh], h[fresh]
            cut = int(np.searchsorted(k, k[-1]))  # the last key may run on
            yield from _runs(k[:cut], h[:cut], crowded)
            if crowded and crowded[0] != k[-1]:
                crowded = None
            if len(k) - cut > 4 * FEW:
                # send what there is; the last row stays, to tell repeats
                crowded = crowded or (k[-1], h[cut])
                n = len(k) - 1 - cut
                yield _rows(np.ones(n, bool), k[cut:-1], np.full(n, crowded[1]), h[cut:-1])
                cut = len(k) - 1
            k, h = k[cut:], h[cut:]
        yield from _runs(k, h, crowded)

    return rows.repartition("k").sortWithinPartitions("k", "h1").mapInArrow(read, "many boolean, k long, a long, b long")


def _rows(many, k, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(map(pa.array, (many, k, a, b))), names=["many", "k", "a", "b"])


def _runs(k: np.ndarray, h: np.ndarray, crowded: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    if not len(k):
        return
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(start, len(k)))
    lots, least = size > FEW, h[start]
    if crowded:
        runs_on = k[start] == crowded[0]
        lots |= runs_on
        least = np.where(runs_on, crowded[1], least)
    row = np.repeat(lots, size)
    if row.any():
        yield _rows(np.ones(int(row.sum()), bool), k[row], np.repeat(least, size)[row], h[row])
    left, right = [], []
    for n in range(2, FEW + 1):
        at = start[(size == n) & ~lots]
        if len(at):
            i, j = np.triu_indices(n, 1)
            left.append(h[at[:, None] + i].ravel())
            right.append(h[at[:, None] + j].ravel())
    if left:
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        none = np.zeros(len(pairs), np.int64)
        yield _rows(np.zeros(len(pairs), bool), none, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))


def features(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, h1, h2, n, text, own, sketch, above) of candidate sets, from (doc,
    h1, h2, n, text): the text (a fraction of its set's size when packed), the
    set's join band and the bit sketches for that band and for the one above
    (null if it takes no part there)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = bands_for(percent)
        for batch in batches:
            h1, h2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            keep, own_band, sketch, above = [], [], [], []
            for i, own in _sets(batch.column(4), width):
                if set_key(own) != (h1[i], h2[i]):
                    continue  # another text of the same document
                js = bands.of(len(own))
                keep.append(i)
                own_band.append(js[0])
                sketch.append(bit_sketch(own, js[0], bands))
                above.append(bit_sketch(own, js[1], bands) if len(js) > 1 else None)
            few = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [few.column(c) for c in range(5)]
                + [pa.array(own_band, pa.int32()), pa.array(sketch, pa.binary()), pa.array(above, pa.binary())],
                names=["doc", "h1", "h2", "n", "text", "own", "sketch", "above"],
            )

    return docs.mapInArrow(
        build, "doc long, h1 long, h2 long, n long, text string, own int, sketch binary, above binary"
    )


def _same_band(s: dict, t: dict) -> tuple[bytes, bytes] | None:
    """Both sketches for a join band that both take part in."""
    if s["own"] == t["own"]:
        return s["sketch"], t["sketch"]
    if s["own"] + 1 == t["own"] and s["above"] is not None:
        return s["above"], t["sketch"]
    if t["own"] + 1 == s["own"] and t["above"] is not None:
        return s["sketch"], t["above"]
    return None


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose sketches are within the bound."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = bands_for(percent)
        for batch in batches:
            near = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = _same_band(s, t)
                near.append(bool(both) and _hamming(*both) <= bands.differ(s["n"], t["n"]))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    cols = ["n", "own", "sketch", "above"]
    side = lambda key, name: sketches.select(F.col("h1").alias(key), F.struct(*cols).alias(name))
    joined = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b")
    lo, hi = F.least("s.n", "t.n"), F.greatest("s.n", "t.n")
    return joined.where(100 * lo >= percent * hi).select("a", "b", "s", "t").mapInArrow(look, "a long, b long")


def _hamming(a: bytes, b: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())


def _span(members: DataFrame, sketches: DataFrame, failed: DataFrame, percent: int, reach: int) -> DataFrame:
    """(k, a, b, open): pairs of set keys to verify for words that many sets
    share (``members``: k, a and the group the set is known to belong to).

    A word's sets are dealt to blocks by their hash, and each pair of blocks is
    gone through by itself.  Two groups are taken for connected after ``reach``
    pairs between them, which are then ``open``; else all pairs between them
    that are within the bound and not in ``failed`` (k, a, b) are there."""
    per = members.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = members.join(per, "k").withColumn("i", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "k", "a", "group", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") <= F.col("j")).alias("low")
    )
    # of a set's two sketches only the one for the word's band is sent
    sk = sketches.select(F.col("h1").alias("a"), "n", "own", F.col("sketch").alias("mine"), "above")
    fit = F.when(F.col("k").bitwiseAND((1 << BAND_BITS) - 1) == F.col("own"), F.col("mine")).otherwise(F.col("above"))
    rows = dealt.join(sk, "a").select(
        "k", "lo", "hi", "a", F.lit(None).cast("long").alias("b"), "group", "low", "n", fit.alias("sketch")
    )
    # a failed pair goes to the pair of blocks that would find it
    block = lambda key: F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    out = failed.join(per, "k").select("k", F.least(block("a"), block("b")).alias("lo"), F.greatest(block("a"), block("b")).alias("hi"), "a", "b")
    rows = rows.unionByName(out, allowMissingColumns=True)
    schema = "k long, a long, b long, open boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = bands_for(percent)
        held: list[pa.RecordBatch] = []  # the rows so far of the last key
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(3)):
                yield _spanning(held, bands, reach)
                held = []
            start = 0
            for edge in edges.tolist():
                yield _spanning([*held, batch.slice(start, edge - start)], bands, reach)
                held, start = [], edge
            held.append(batch.slice(start))
        if held:
            yield _spanning(held, bands, reach)

    return rows.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "a").mapInArrow(read, schema)


def _spanning(batches: list[pa.RecordBatch], bands: Bands, reach: int) -> pa.RecordBatch:
    """The pairs to verify among the sets of one word in one pair of blocks."""
    own = pa.Table.from_batches(batches)
    word, cross = own["k"][0].as_py(), own["lo"][0].as_py() != own["hi"][0].as_py()
    key, other = own["a"].to_numpy(), own["b"].to_pylist()
    banned = {(a, b) for a, b in zip(key.tolist(), other, strict=True) if b is not None}
    bits, keep = [], []
    for i, w in enumerate(own["sketch"].to_pylist()):
        if w is not None and not (keep and key[keep[-1]] == key[i]):
            keep.append(i)
            bits.append(np.frombuffer(w, np.uint64))
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by the two groups
    joined: set[tuple[int, int]] = set()
    if len(keep) > 1:
        key, percent = key[keep], bands.percent
        size = own["n"].to_numpy()[keep].astype(np.int64)
        low = own["low"].to_numpy()[keep].astype(bool)
        bits = np.stack(bits)
        # with nulls (failed pairs, not kept) ids would become floats
        group = np.unique(own["group"].fill_null(0).to_numpy()[keep], return_inverse=True)[1]
        # first only pairs well within the bound, which hardly ever fail
        # verification, then all pairs between what these leave apart
        for sure in (True, False):
            for i in range(len(key) - 1):
                rest = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
                if cross:  # within one block all pairs, else those across
                    rest = rest[low[rest] != low[i]]
                bound = (100 - percent) * (size[rest] + size[i]) // (100 + percent)
                near = np.abs(size[rest] - size[i]) <= bound
                rest, bound = rest[near], bound[near]
                if not len(rest):
                    continue
                if sure:  # less what meeting bits may hide
                    hidden = bound / (2 * BITS)
                    bound = bound - 2 * (1 + hidden + 3 * np.sqrt(hidden))
                rest = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64) <= bound]
                for x in rest.tolist():
                    pair = (int(key[i]), int(key[x]))
                    if group[x] == group[i] or pair in banned:
                        continue
                    two = (min(int(group[i]), int(group[x])), max(int(group[i]), int(group[x])))
                    between = found.setdefault(two, [])
                    if pair not in between:
                        between.append(pair)
                    if sure or len(between) >= reach:
                        joined.add(two)
                        group[group == two[1]] = two[0]
            if (group == group[0]).all():
                break
    pairs = [(*pair, two in joined) for two, own in found.items() for pair in own]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(pairs), word, np.int64)),
            pa.array([p[0] for p in pairs], pa.int64()),
            pa.array([p[1] for p in pairs], pa.int64()),
            pa.array([p[2] for p in pairs], pa.bool_()),
        ],
        names=["k", "a", "b", "open"],
    )


def _verify(pairs: DataFrame, traits: DataFrame, width: int, percent: int, folder: str) -> DataFrame:
    """(a, b, u, v, linked) of pairs of set keys, from the sets' texts; u and v
    are the documents that stand for them.  Texts of other sets do not travel
    where the keys asked for are few, as they are in later rounds."""
    asked = _stored(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct(), folder)
    sets = traits.join(asked, "h1", "left_semi")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = bands_for(percent)
        for whole in batches:
            for batch in (whole.slice(i, VERIFIED) for i in range(0, whole.num_rows, VERIFIED)):
                # every text here has words, so the two runs keep in step
                good = []
                for (_, s), (_, t) in zip(_sets(batch.column(4), width), _sets(batch.column(5), width), strict=True):
                    if len(s) > len(t):
                        s, t = t, s
                    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                    good.append(bands.linked(int((t[at] == s).sum()), len(s), len(t)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array(good, pa.bool_())], names=["a", "b", "u", "v", "linked"]
                )

    side = lambda key, doc, name: sets.select(
        F.col("h1").alias(key), F.col("doc").alias(doc), F.col("text").alias(name)
    )
    both = pairs.join(side("a", "u", "s"), "a").join(side("b", "v", "t"), "b")
    return both.select("a", "b", "u", "v", "s", "t").mapInArrow(look, "a long, b long, u long, v long, linked boolean")


def _stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a stored table; the shuffle files it was made from may go."""
    out = materialise(df, folder)
    release(df.sparkSession)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(doc, n_shingles, component_id), one row for each row of ``docs``:
    documents link when 100 * intersection >= percent * union of their
    ``width``-word shingles."""
    work = scratch(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    table = _stored(set_table(texts, width))
    known = texts.where(F.col("doc").isNotNull())
    shown = table.where((F.col("n") > 0) & F.col("doc").isNotNull())
    sets = _stored(shown.groupBy("h1", "h2", "n").agg(F.min("doc").alias("doc")))

    shared = _stored(shared_words(word_rows(known, width, percent)), work)
    pairs = shared.where(~F.col("many")).select("a", "b")
    least = shared.where(F.col("many") & (F.col("a") != F.col("b"))).select("a", "b")
    members = shared.where(F.col("many")).select("k", F.col("b").alias("a")).distinct()
    wanted = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).union(members.select("a")).distinct()
    source = (
        sets.join(wanted, "h1")
        .join(known, "doc")
        .groupBy("doc", "h1", "h2", "n", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"))
        .agg(F.first("text").alias("text"))
        .select("doc", "h1", "h2", "n", "text")
    )
    traits = _stored(features(source, width, percent), work)

    # the texts of a document that has several are linked by it
    several = shown.groupBy("doc").agg(F.count_distinct("h1", "h2", "n").alias("texts")).where(F.col("texts") > 1)
    own = shown.join(several, "doc").join(sets.withColumnRenamed("doc", "u"), ["h1", "h2", "n"])
    own = own.select("u", F.col("doc").alias("v"))

    ask = _stored(_near(pairs.union(least).distinct(), traits, percent), work)
    seen = found = spans = None
    reach = REACH
    while True:
        now = _stored(_verify(ask, traits, width, percent, work), work)
        seen = now if seen is None else seen.union(now)
        if now.where(F.col("linked")).limit(1).count() or found is None:
            found = components(seen.where(F.col("linked")).select("u", "v").union(own), work)
            release(docs.sparkSession)
        group = traits.select("h1", "doc").join(found.select(F.col("u").alias("doc"), "v"), "doc", "left")
        group = _stored(group.select("h1", F.coalesce("v", "doc").alias("group")).distinct(), work)
        one, two = group.toDF("a", "group"), group.toDF("b", "other")
        apart = _stored(seen.where(~F.col("linked")).join(one, "a").join(two, "b").where("group <> other").select("a", "b").distinct(), work)
        if spans is None:
            # words whose sets are not all connected yet
            some = members.join(one, "a").groupBy("k").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
            words = some.where("lo <> hi").select("k")
        else:
            # a failed pair matters only if its word was left on the strength
            # of it and nothing else connects the two
            words = spans.where(F.col("open")).join(apart, ["a", "b"], "left_semi").select("k").distinct()
        again = _stored(members.join(words, "k", "left_semi").join(one, "a").select("k", "a", "group"), work)
        if again.isEmpty():
            break
        out = again.select("k", F.col("a").alias("b")).join(apart, "b").join(again, ["k", "a"], "left_semi").select("k", "a", "b")
        spans = _stored(_span(again, traits, out, percent, reach), work)
        ask = _stored(spans.select("a", "b").distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti"), work)
        reach *= 16

    # what follows reads the sets and components only
    found = _stored(found)
    discard(docs.sparkSession, work)
    stands = sets.join(found.select(F.col("u").alias("doc"), "v"), "doc", "left").select(
        "h1", "h2", "n", F.coalesce("v", "doc").alias("component_id")
    )
    labelled = shown.join(stands, ["h1", "h2", "n"]).select("doc", F.col("n").alias("n_shingles"), "component_id")
    rest = table.where((F.col("n") == 0) | F.col("doc").isNull())
    return labelled.union(rest.select("doc", "n", "doc"))
