"""BPE encoding and decoding with a public vocabulary file.

Merging runs in batched numpy rounds: the symbols of many words lie in one
flat array; each round looks all neighbouring pairs up by binary search over
the sorted pair keys, takes each word's lowest rank, and merges every
occurrence of that pair from left to right.  Each distinct word of a batch is
merged once, and a bounded cache keeps recent words between batches.

Spark splits the documents; a task holds one batch at a time and nothing is
shuffled.

Defined cases: a null text is an empty text and has no ids; the decoded text
of no ids is empty; repeated rows are encoded alike; an empty table gives an
empty table; columns other than the text pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: A longer word is merged by itself with a heap, not in the rounds.
LONG_WORD = 256
#: Words kept between batches by each Python worker.
CACHE_WORDS = 200_000
#: Documents are handled in slices of so many characters, a longer one alone.
SLICE_CHARS = 4_000_000
#: Unicode white space as the file's pattern takes it.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_WORDS = re.compile(_SUFFIXES + "|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")
_WORDS = regex.compile(_SUFFIXES + "|\\p{L}+|\\p{N}|[^" + BLANK + "\\p{L}\\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    one, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary file of words with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([self.vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        keys = self.left * self.size + self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.rank_of = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        chars = byte_symbols()
        self.inner = np.array([self.vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in chars], dtype=np.int64)
        self.token = [""] * self.size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.cache: dict[str, tuple[str, str]] = {}

    # ------------------------------------------------------------ splitting
    def segments(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        return self.special_re.split(text) if "<|" in text else [text]

    @staticmethod
    def words(segment: str) -> list[str]:
        """The normalised words of ordinary text."""
        if segment.isascii():
            return _ASCII_WORDS.findall(segment.lower())
        # one sigma for all places, as characters are lower-cased one by one
        return _WORDS.findall(unicodedata.normalize("NFC", segment).replace("Σ", "σ").lower())

    # -------------------------------------------------------------- merging
    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        long = np.flatnonzero(sizes > LONG_WORD)
        done_sym, done_word = [], []
        for w in long.tolist():
            ids = self.merge_long(sym[ends[w] - sizes[w] : ends[w]].tolist())
            done_sym.append(np.array(ids, dtype=np.int64))
            done_word.append(np.full(len(ids), w))
        if len(long):
            short = sizes[word] <= LONG_WORD
            sym, word = sym[short], word[short]
        while len(sym) > 1:
            key = np.where(word[1:] == word[:-1], sym[:-1] * self.size + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))
            rank = np.append(rank, len(self.ranks))  # the last symbol opens no pair
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(word)))
            low = np.repeat(np.minimum.reduceat(rank, first), count)
            over = low == len(self.ranks)
            if over.any():  # words without a pair left are done
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, low = sym[~over], word[~over], rank[~over], low[~over]
                if not len(sym):
                    break
            hit = rank == low
            # of overlapping hits (a run of one symbol) every second is merged
            if (hit[1:] & hit[:-1]).any():
                at = np.flatnonzero(hit)
                fresh = np.append(True, np.diff(at) > 1)
                run = np.repeat(at[fresh], np.diff(np.append(np.flatnonzero(fresh), len(at))))
                hit[at[(at - run) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word = sym[stay], word[stay]
        all_sym, all_word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
        back = np.argsort(all_word, kind="stable")
        return all_sym[back], np.bincount(all_word, minlength=len(words))

    def merge_long(self, sym: list[int]) -> list[int]:
        """One word by a heap of its pairs, lowest rank and leftmost first."""
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        rank = lambda i: self.rank_of.get(sym[i] * self.size + sym[after[i]]) if after[i] < len(sym) else None
        heap = [(r, i) for i in range(len(sym)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if sym[i] < 0 or rank(i) != r:
                continue
            gone = after[i]
            sym[i] = int(self.made[r])
            sym[gone] = -1
            after[i] = after[gone]
            if after[i] < len(sym):
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (x := rank(j)) is not None:
                    heapq.heappush(heap, (x, j))
        return [s for s in sym if s >= 0]

    # ---------------------------------------------------- ids and their text
    def learn(self, words: set[str]) -> None:
        """Put the words into the cache: their ids and their decoded text."""
        fresh = sorted(words.difference(self.cache))
        if not fresh:
            return
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
            fresh = sorted(words)
        flat, counts = self.merge_words([w.encode("utf-8", "surrogatepass") for w in fresh])
        ids, ends = flat.tolist(), np.cumsum(counts).tolist()
        start = 0
        for w, end in zip(fresh, ends, strict=True):
            own = ids[start:end]
            self.cache[w] = (" ".join(map(str, own)), self.decode(own))
            start = end

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by a space: the file names no decoder."""
        return " ".join([self.token[i] for i in ids])

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by a space, decoded text) of each text."""
        split = [[(s, k % 2 == 1) for k, s in enumerate(self.segments(t)) if s] for t in texts]
        parts = [[([s] if odd else self.words(s), odd) for s, odd in one] for one in split]
        seen: set[str] = set()
        for one in parts:
            for ws, odd in one:
                if not odd:
                    seen.update(ws)
        self.learn(seen)
        cache, out = self.cache, []
        for one in parts:
            found = []
            for ws, odd in one:
                found += [(str(self.special[ws[0]]), ws[0])] if odd else [cache[w] for w in ws]
            out.append((" ".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The vocabulary, once in each Python worker."""
    return WordBpe(path)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(
    docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = True, prefix: str = ""
) -> DataFrame:
    """``docs`` without the text column and with ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` (digests of the decimal ids and of the decoded text)
    and, if ``keep_ids``, ``ids``.  Added names get ``prefix``; they must not
    be columns of ``docs``."""
    others = [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in others] + [
        StructField(prefix + "n_tokens", LongType()),
        StructField(prefix + "ids_sha256", StringType()),
        StructField(prefix + "decoded_sha256", StringType()),
    ]
    if keep_ids:
        fields.append(StructField(prefix + "ids", ArrayType(IntegerType())))
    names = [f.name for f in fields]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(len(others)).to_pylist()]
            for a, b in slices(texts):
                counts, ids_sha, text_sha, ids, ends = [], [], [], [], [0]
                for coded, decoded in bpe.encode_texts(texts[a:b]):
                    counts.append(coded.count(" ") + 1 if coded else 0)
                    ids_sha.append(sha(coded))
                    text_sha.append(sha(decoded))
                    if keep_ids:
                        ids.append(np.array(coded.split(), dtype=np.int32))
                        ends.append(ends[-1] + len(ids[-1]))
                columns = [batch.column(k).slice(a, b - a) for k in range(len(others))]
                columns += [pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*[f"`{c}`" for c in [*others, text_col]]).mapInArrow(encode, StructType(fields))
