"""Vector codes: product codebooks trained and applied in whole numbers.

Every vector is cut into equal consecutive parts; each part position has a
codebook, started from the vectors of the smallest ids and improved by a fixed
number of rounds (assign every part to the nearest entry, then replace each
entry by the floor of its parts' mean).

Nearest entries are found in the Walsh-Hadamard domain.  Parts and entries are
filled up with zeros to a power of two P and transformed; the transform keeps
squared distances up to the factor P and gathers a part's coarse shape in the
first sequencies.  Scaled squared differences are added up in sequency order:
after the first few of them the most promising entry's whole distance is a
bound, and every entry whose sum so far is above it is eliminated (sums only
grow).  All of it is integer arithmetic, so results are exact, and of equal
distances the lower index wins.

On Spark: one pass over the vectors a round, with the codebooks (a fixed
number of entries) as a broadcast; every task adds up its parts by entry, and
Spark adds the tasks' sums by (part, entry).  A round returns at most parts x
entries rows of sums to the driver, whatever the input.  Errors by label are
one aggregation joined back to the rows, which adaptive execution splits
where a label holds very many.

Defined cases: rows whose vector is null or holds a null, NaN or infinite
component are left out; null ids and null labels are kept (null ids come
last among the first entries; null labels are one label); repeated rows are
coded alike and all count; vectors shorter than the longest, or not a
multiple of the parts, are filled up with zeros; an empty table has no rows
and codebooks without entries.  Components so large that sums could pass 64
bits raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.tables import materialise
from shopfloor.llm.vectors import integer_vectors, largest, lists, stack, within

#: Rows of a batch compared with all entries at once.
ROWS_AT_ONCE = 1024
#: Sequencies added up before the first elimination, and between later ones.
FIRST, STEP = 4, 2


def sequency_order(size: int) -> np.ndarray:
    """Row numbers of the Hadamard matrix by number of sign changes: the
    reversed bits of the Gray code."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return sum(((gray >> k) & 1) << (bits - 1 - k) for k in range(bits)) if bits else np.zeros(1, dtype=np.int64)


def walsh(rows: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of each row (filled up with zeros to a
    power of two), in sequency order."""
    n, width = rows.shape
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((n, size), dtype=np.int64)
    out[:, :width] = rows
    half = 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return out[:, sequency_order(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (the lower of equals) and its
    squared distance."""
    x, e = walsh(parts), walsh(entries)
    size = x.shape[1]
    index, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for a in range(0, len(x), ROWS_AT_ONCE):
        own = x[a : a + ROWS_AT_ONCE]
        # the first sequencies of every pair, then only pairs still possible
        first = min(FIRST, size)
        total = np.zeros((len(own), len(e)), dtype=np.int64)
        for s in range(first):
            total += np.square(own[:, s, None] - e[None, :, s])
        guess = total.argmin(axis=1)
        bound = np.square(own - e[guess]).sum(axis=1)
        row, col = np.nonzero(total <= bound[:, None])
        total = total[row, col]
        for s in range(first, size, STEP):
            for t in range(s, min(s + STEP, size)):
                total += np.square(own[row, t] - e[col, t])
            stay = total <= bound[row]
            row, col, total = row[stay], col[stay], total[stay]
        # every row keeps its guess at least; pairs are in order of row, entry
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(total, start)
        at = np.flatnonzero(total == np.repeat(least, np.diff(np.append(start, len(row)))))
        at = at[np.append(True, row[at][1:] != row[at][:-1])]
        index[a : a + len(own)], error[a : a + len(own)] = col[at], least // size
    return index, error


def _cut(matrix: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(matrix, parts, axis=1)


def _assigned(q: DataFrame, codebooks: list[np.ndarray], width: int, sums: bool) -> DataFrame:
    """With ``sums``: part, entry, rows and the sum of each component of the
    parts nearest to it, by task; else id, label, codes and error by row."""
    parts, wide = len(codebooks), width // len(codebooks)
    shared = q.sparkSession.sparkContext.broadcast(codebooks)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        total = [np.zeros((len(b), wide), dtype=np.int64) for b in books]
        for batch in batches:
            for k, part in enumerate(_cut(stack(batch.column(2), width), parts)):
                index, _ = nearest(part, books[k])
                count[k] += np.bincount(index, minlength=len(books[k]))
                order = np.argsort(index, kind="stable")
                found, start = np.unique(index[order], return_index=True)
                if len(found):
                    total[k][found] += np.add.reduceat(part[order], start, axis=0)
        for k in range(parts):
            used = np.flatnonzero(count[k])
            columns = [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(count[k][used])]
            columns += [pa.array(total[k][used, c], pa.int64()) for c in range(wide)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{c}" for c in range(wide)]])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            found = [nearest(p, b) for p, b in zip(_cut(stack(batch.column(2), width), parts), books, strict=True)]
            codes = np.stack([index for index, _ in found], axis=1)
            error = sum(e for _, e in found)
            columns = [batch.column(0), batch.column(1), lists(codes), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "codes", "error"])

    if sums:
        fields = ", ".join(f"s{c} long" for c in range(wide))
        return q.mapInArrow(add_up, f"part int, entry int, n long{', ' if wide else ''}{fields}")
    kinds = {f.name: f.dataType.simpleString() for f in q.schema}
    return q.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, codes array<long>, error long")


def train(q: DataFrame, width: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks (one of at most ``entries`` entries for each part)."""
    # of equal ids, the order of the components decides
    seeds = q.orderBy(F.col("id").asc_nulls_last(), F.col("q")).limit(entries).select("q").toArrow()
    books = _cut(stack(seeds.column(0), width), parts)
    wide = width // parts
    for _ in range(rounds if len(books[0]) else 0):
        by_task = _assigned(q, books, width, sums=True)
        added = by_task.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(f"s{c}") for c in range(wide)]).collect()
        books = [b.copy() for b in books]
        for row in added:
            books[row[0]][row[1]] = np.array(row[3:], dtype=np.int64) // row[2]
    return books


def vector_codes(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """``id``, ``label``, ``codes`` (one index a part), ``error`` (squared
    distances summed over the parts) and ``label_error`` (errors summed over
    equal labels), and the codebooks."""
    q = materialise(integer_vectors(vectors, id_col, vector_col, label_col, scale))
    longest, most = largest(q)
    width = parts * -(-longest // parts)
    size = 1 << max(0, width // parts - 1).bit_length()
    within(most, isqrt((1 << 62) // (4 * size**3 * parts)), ["vector codes"])
    books = train(q, width, parts, entries, rounds)
    coded = materialise(_assigned(q, books, width, sums=False))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all components by part, entry and place, in decimal."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
