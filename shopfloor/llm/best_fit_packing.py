"""Best-fit packing of token sequences by a grouping genetic algorithm.

A document's ids (and the end id) are one piece, or, where they are longer
than a sequence, pieces of a sequence's length, of which the first may be
shorter.  Full pieces fill a sequence each; the others are packed.

A plan puts every piece of a block into a bin (a sequence).  Plans are bred:
the child of two plans starts as the first, well-filled bins of the second are
injected whole, bins of the first that hold one of their pieces (it would be
there twice) are dissolved, and the pieces displaced by that are put back: a
displaced piece takes the place of a somewhat shorter one where that fills a
bin better, and what is left goes, longest first, into the bin that it fits
best.  Mutation dissolves the emptiest bins and a few others.  Plans are
ranked by their number of bins, then by the sum of squared fills, which
prefers full bins and empty ones to halves.  The first plans are best fit in
descending order, so that no result is worse than that, and bins filled one
by one by pieces of matching lengths; others are best fit in noisy order.

On Spark: pieces are dealt evenly into blocks of a bounded size.  Each block
is bred on several islands, a task each; after an epoch every island writes
its plans, its best one migrates to the next island of the block, and the next
epoch goes on from there.  A block that has as few bins as its tokens need at
least is left as it is.  The bins that the best plans leave emptiest are
dissolved, and their pieces packed once more, in blocks made of many blocks'
rest, so that waste does not grow with the number of blocks.  Shuffles carry
lengths and plans, never texts or ids.

Defined cases: a null text is an empty text, and its piece is the end id
alone; null and repeated ids are kept, each row is a document of its own;
equal lengths are placed in the order of the pieces' rows; an empty table
gives an empty table; a very long text is many pieces, dealt into many blocks;
other columns are not used.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.byte_ids import byte_ids
from shopfloor.llm.tables import materialise

#: Pieces of a block; islands of a block; epochs, and generations of each.
BLOCK_PIECES, ISLANDS, EPOCHS, GENERATIONS = 8192, 3, 2, 20
#: Islands bred one after the other by a task.
ISLANDS_PER_TASK = 4
#: Texts of so many bytes are encoded at once, a longer one alone.
SLICE_BYTES = 2_000_000
#: Plans of an island; share of a plan's bins that a child gets injected.
PLANS, INJECTED = 4, 0.15
#: Share of bins, from the emptiest, that are packed again with other blocks'.
AGAIN = 0.06


# ---------------------------------------------------------------- one block
def best_fit(pieces: np.ndarray, sizes: np.ndarray, room: list[int], limit: int) -> np.ndarray:
    """A bin for each piece, in their order: the one that is left with the
    least room, else a new one.  ``room`` (of each bin) is kept up to date.
    The rooms there are, as bits of one number, make that a shift."""
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    there = 0
    for b, r in enumerate(room):
        if r:
            open_bins[r].append(b)
            there |= 1 << r
    out = []
    for size in sizes[pieces].tolist():
        fits = there >> size
        if fits:
            r = size + ((fits & -fits).bit_length() - 1)
            b = open_bins[r].pop()
            if not open_bins[r]:
                there ^= 1 << r
        else:
            r, b = limit, len(room)
            room.append(limit)
        room[b] = r - size
        if r > size:
            open_bins[r - size].append(b)
            there |= 1 << (r - size)
        out.append(b)
    return np.array(out, dtype=np.int64)


def fresh(order: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """A plan by best fit, pieces taken in the given order."""
    plan = np.empty(len(sizes), dtype=np.int64)
    plan[order] = best_fit(order, sizes, [], limit)
    return plan


def filled(sizes: np.ndarray, limit: int) -> np.ndarray:
    """A plan made bin by bin: the longest piece left, then one or two pieces
    that fill the bin exactly if there are such, else the longest that fits,
    and so on.  Sets of lengths are bits of a number, so that all pairs of a
    sum are one intersection with the mirrored set."""
    by_size = [[] for _ in range(limit + 1)]
    for piece in range(len(sizes) - 1, -1, -1):
        by_size[sizes[piece]].append(piece)
    there = sum(1 << n for n, own in enumerate(by_size) if own)
    mirror = sum(1 << (limit - n) for n, own in enumerate(by_size) if own)
    plan, b = np.empty(len(sizes), dtype=np.int64), 0
    while there:
        room, n = limit, there.bit_length() - 1
        while True:
            plan[by_size[n].pop()] = b
            room -= n
            if not by_size[n]:
                there ^= 1 << n
                mirror ^= 1 << (limit - n)
            fits = there & ((1 << (room + 1)) - 1)
            if not fits:
                break
            n = fits.bit_length() - 1
            if n != room:
                pairs = fits & (mirror >> (limit - room))
                if room % 2 == 0 and pairs >> (room // 2) & 1 and len(by_size[room // 2]) < 2:
                    pairs ^= 1 << (room // 2)
                if pairs:
                    n = pairs.bit_length() - 1
        b += 1
    return plan


def rank(plan: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """Fewer bins, then fuller ones, come first."""
    fill = np.bincount(plan, weights=sizes).astype(np.int64)
    return int((fill > 0).sum()), -int(np.square(fill).sum())


def dissolve(plan: np.ndarray, gone: np.ndarray, sizes: np.ndarray, limit: int, rng) -> np.ndarray:
    """The plan without the bins of ``gone``, their pieces put back."""
    return put_back(np.where(gone[plan], -1, plan), sizes, limit, rng)


def put_back(plan: np.ndarray, sizes: np.ndarray, limit: int, rng) -> np.ndarray:
    """Place the pieces without a bin (-1)."""
    plan = plan.copy()
    placed = np.flatnonzero(plan >= 0)
    names, bins = np.unique(plan[placed], return_inverse=True)
    plan[placed] = bins
    room = (limit - np.bincount(bins, weights=sizes[placed], minlength=len(names)).astype(np.int64)).tolist()
    loose = np.flatnonzero(plan < 0)
    loose = loose[np.argsort(sizes[loose], kind="stable")]
    waiting, lengths = loose.tolist(), sizes[loose].tolist()
    # a loose piece for a shorter one of a bin with room, if it fills the bin better
    slack = np.array(room)
    some = placed[slack[bins] > 0]
    some = some[rng.permutation(len(some))]
    for piece, own, b in zip(some.tolist(), sizes[some].tolist(), plan[some].tolist(), strict=True):
        r = room[b]
        if r and lengths:
            at = bisect_left(lengths, own + r + 1) - 1
            if at >= 0 and lengths[at] > own:
                room[b] = own + r - lengths[at]
                plan[waiting[at]], plan[piece] = b, -1
                del waiting[at], lengths[at]
                at = bisect_left(lengths, own)
                waiting.insert(at, piece)
                lengths.insert(at, own)
    rest = np.array(waiting[::-1], dtype=np.int64)
    if len(rest):
        plan[rest] = best_fit(rest, sizes, room, limit)
    return plan


def cross(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, limit: int, rng) -> np.ndarray:
    """A child of two plans: well-filled bins of ``other`` injected whole."""
    fill = np.bincount(other, weights=sizes)
    well = np.argsort(-fill + rng.random(len(fill)) * limit / 64)
    well = well[: max(1, len(well) // 2)]
    take = np.zeros(len(fill), bool)
    take[rng.choice(well, size=max(1, int(len(fill) * INJECTED)), replace=len(well) < len(fill) * INJECTED)] = True
    injected = take[other]
    twice = np.zeros(int(one.max()) + 1, bool)
    twice[one[injected]] = True
    child = np.where(injected, other + len(twice), np.where(twice[one], -1, one))
    return put_back(child, sizes, limit, rng)


def mutate(plan: np.ndarray, sizes: np.ndarray, limit: int, rng) -> np.ndarray:
    """Dissolve the emptiest bins and some others."""
    fill = np.bincount(plan, weights=sizes)
    gone = rng.random(len(fill)) < 0.01
    gone[np.argsort(fill + rng.random(len(fill)) * limit / 8)[: max(2, len(fill) // 50)]] = True
    return dissolve(plan, gone, sizes, limit, rng)


def evolve(sizes: np.ndarray, plans: list[np.ndarray], limit: int, seed: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """Some generations of one island, from the plans given and, up to
    ``PLANS``, new ones; best plan first."""
    rng = np.random.default_rng(seed)
    needed = -(-int(sizes.sum()) // limit)
    if not plans:
        plans = [fresh(np.argsort(-sizes, kind="stable"), sizes, limit), filled(sizes, limit)]
    kept = sorted(((rank(p, sizes), k, p) for k, p in enumerate(plans)), key=lambda x: x[:2])
    born = len(kept)
    while len(kept) < PLANS and kept[0][0][0] > needed:
        noisy = np.argsort(-sizes * (1 + 0.2 * rng.random(len(sizes))), kind="stable")
        plan = fresh(noisy, sizes, limit)
        kept.append((rank(plan, sizes), born, plan))
        born += 1
    for _ in range(generations):
        kept = sorted(kept, key=lambda x: x[:2])[:PLANS]
        if kept[0][0][0] <= needed:
            break
        parents = len(kept)
        for _ in range(PLANS // 2):
            # of two drawn, the better is a parent
            a, b = (min(rng.integers(parents, size=2)) for _ in range(2))
            child = cross(kept[a][2], kept[b][2], sizes, limit, rng) if a != b else kept[a][2]
            if a == b or rng.random() < 0.5:
                child = mutate(child, sizes, limit, rng)
            kept.append((rank(child, sizes), born, child))
            born += 1
    return [p for _, _, p in sorted(kept, key=lambda x: x[:2])[:PLANS]]


# -------------------------------------------------------------------- pieces
def _spans(texts: pa.Array) -> list[tuple[int, int]]:
    """(a, b) of the texts that are encoded at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = (np.flatnonzero(np.diff(ends // SLICE_BYTES, append=-1)) + 1).tolist()  # after each so many bytes
    return list(zip([0, *cuts], cuts, strict=False))


def cut_pieces(
    docs: DataFrame,
    path: str,
    limit: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc, piece (from 0), start, length, ids_crc32 (of
    the ids as little-endian unsigned 32-bit numbers) and, with ``keep_ids``,
    ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_ids(path)
        for batch in batches:
            for a, b in _spans(batch.column(1)):
                ids, total = coder.encode(batch.column(1).slice(a, b - a), end_id)
                pieces = -(-total // limit)
                doc = np.repeat(np.arange(a, b), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = total - (pieces - 1) * limit  # the first piece
                start = np.where(number, np.repeat(head, pieces) + (number - 1) * limit, 0)
                length = np.where(number, limit, np.repeat(head, pieces))
                at = np.repeat(np.cumsum(total) - total, pieces) + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start, pa.int64())]
                columns += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)
            pa.default_memory_pool().release_unused()  # the worker lives on for other stages

    own = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc {own.schema['doc'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<long>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return own.mapInArrow(cut, schema)


# ------------------------------------------------------------------- packing
def _islands(loose: DataFrame, blocks: int, limit: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """The best plan of each block (of pieces: block, row, length): its bins
    as bytes, for the pieces from the longest, equal ones by row."""
    tasks = -(-blocks * islands // ISLANDS_PER_TASK)  # their work is not in their size
    lengths = loose.select("block", "length").groupBy("block")

    def lay_out(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(pdf["length"].to_numpy())[::-1].astype("<i4").tobytes()
        return pd.DataFrame({"block": key[0], "island": np.arange(islands, dtype=np.int32), "sizes": sizes, "plan": None, "bins": 0, "waste": 0, "place": 0})

    state_schema = "block long, island int, sizes binary, plan binary, bins long, waste long, place int"
    state = lengths.applyInPandas(lay_out, state_schema)

    def epoch(number: int):
        def breed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            sizes = np.frombuffer(pdf["sizes"].iloc[0], dtype="<i4").astype(np.int64)
            pdf = pdf.sort_values(["bins", "waste", "place"], kind="stable")
            plans = [np.frombuffer(p, dtype="<i4").astype(np.int64) for p in pdf["plan"] if p is not None]
            found = evolve(sizes, plans, limit, hash((seed, number, int(key[0]), int(key[1]))) % (1 << 32))
            ranks = [rank(p, sizes) for p in found]
            return pd.DataFrame(
                {
                    "block": key[0], "island": key[1], "sizes": sizes.astype("<i4").tobytes(),
                    "plan": [p.astype("<i4").tobytes() for p in found], "bins": [r[0] for r in ranks],
                    "waste": [r[1] for r in ranks], "place": np.arange(len(found), dtype=np.int32),
                }
            )

        return breed

    for number in range(epochs):
        state = state.repartition(tasks, "block", "island")
        state = materialise(state.groupBy("block", "island").applyInPandas(epoch(number), state_schema))
        elite = state.filter("place = 0")
        if number + 1 < epochs and islands > 1:
            state = state.unionByName(elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")))
    best = F.min_by("plan", F.struct("bins", "waste", "island", "place"))
    return state.groupBy("block").agg(best.alias("plan"))


def _dealt(pieces: DataFrame, block_pieces: int) -> tuple[DataFrame, int]:
    """Pieces (row, length) with a block, evenly and by their rows' numbers
    alone, and the number of blocks."""
    blocks = max(1, -(-pieces.count() // block_pieces))
    return pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), blocks


def _placed(loose: DataFrame, plans: DataFrame, limit: int, again: float) -> DataFrame:
    """row, length, block, bin, offset and whether the bin is one of the
    emptiest, which are packed again."""

    def place(key: tuple, pdf: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        sizes = pdf["length"].to_numpy()
        bins = np.frombuffer(plan["plan"].iloc[0], dtype="<i4").astype(np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        offset = np.empty(len(bins), dtype=np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        open_ = np.zeros(len(fill), bool)
        # where every bin but one is full nothing can be won
        if again and (fill < limit).sum() > 1:
            open_[np.argsort(fill, kind="stable")[: max(2, int(len(fill) * again))]] = True
        return pd.DataFrame({"row": pdf["row"], "length": sizes, "block": key[0], "bin": bins, "offset": offset, "again": open_[bins]})

    return loose.groupBy("block").cogroup(plans.groupBy("block")).applyInPandas(
        place, "row long, length long, block long, bin long, offset long, again boolean"
    )


def pack(pieces: DataFrame, limit: int = 1024, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """``pieces`` (a stored table with ``length``; other columns pass through,
    and none may be named row, sequence or offset) with ``sequence`` and
    ``offset``: its sequence's number and its place there."""
    # row numbers of a stored table do not change when a task is run again
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    loose = pieces.filter(F.col("length") < limit).select("row", "length")
    dealt, blocks = _dealt(loose, block_pieces)
    placed = materialise(_placed(dealt, _islands(dealt, blocks, limit, islands, epochs, seed), limit, AGAIN))
    rest, blocks = _dealt(placed.filter("again").select("row", "length"), block_pieces)
    second = _placed(rest, _islands(rest, blocks, limit, islands, epochs, seed + 1), limit, 0)
    # three families of numbers: full pieces, first packing, second packing
    number = lambda family: (F.col("block") * (1 << 30) + F.col("bin")) * 3 + family
    where = placed.filter("NOT again").select("row", number(1).alias("sequence"), "offset").unionByName(
        second.select("row", number(2).alias("sequence"), "offset")
    )
    full = pieces.filter(F.col("length") >= limit).withColumn("sequence", F.col("row") * 3).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(pieces.filter(F.col("length") < limit).join(where, "row")).drop("row")


def pack_documents(
    docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc, piece, start, length, ids_crc32 (ids with
    ``keep_ids``), sequence and offset."""
    return pack(materialise(cut_pieces(docs, path, limit, end_id, id_col, text_col, keep_ids)), limit)
