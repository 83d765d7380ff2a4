"""Token counts by dynamic programming over prefixes.

For every prefix of a word two numbers are kept: the tokens of the prefix as
the beginning of a longer word, and the tokens of the prefix as a whole word
(with the end-of-word suffix).  The tokens of a prefix are those of a shorter
prefix and one token more, the only one in the vocabulary that ends there and
may stand after the shorter prefix's last token; two tokens may stand side by
side if no merge across their border comes before the merges that make them.
With these numbers the exact count of any prefix of a text is a sum and one
look-up, so that truncation to a budget needs no second encoding.

Spark splits the documents; distinct words are counted once a batch, and a
bounded cache keeps recent words.  Nothing is shuffled.

Defined cases: a null text is an empty text and has no tokens; repeated rows
are counted alike; an empty table gives an empty table; columns other than
the text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from shopfloor.llm.bpe import BLANK, WordBpe, load, slices

CACHE_WORDS = 300_000
CACHE_PAIRS = 1_000_000
#: Words of more bytes are counted one by one.
ROUND_BYTES = 48
ROUND_WORDS = 50_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Stretches of white space and stretches without.
_STRETCH = regex.compile(f"[{BLANK}]+|[^{BLANK}]+")


class PrefixCounter:
    """Token counts of every prefix under one vocabulary."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        mark = bpe.suffix
        code = {c: b for b, c in enumerate(_symbol_chars(bpe))}
        inner, final = {}, {}
        for token, i in bpe.vocab.items():
            body, table = (token[: -len(mark)], final) if token.endswith(mark) and token != mark else (token, inner)
            raw = bytes(code[c] for c in body)
            table[raw] = i
        # a token that its own symbols are not merged into is never used
        self.final = self._reachable(final, True)
        self.inner = self._reachable(inner, False)
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.parts = {m: (a, b, r) for r, (a, b, m) in enumerate(zip(bpe.left.tolist(), bpe.right.tolist(), bpe.made.tolist(), strict=True))}
        self.spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, int] = {}
        self.power = np.array([pow(int(BASE), n, 1 << 64) for n in range(self.longest + 1)], dtype=np.uint64)
        self.inner_at, self.final_at = self._by_length(self.inner), self._by_length(self.final)
        self.known, self.known_fit = np.zeros(0, np.int64), np.zeros(0, bool)

    def _reachable(self, tokens: dict[bytes, int], whole: bool) -> dict[bytes, int]:
        if whole:
            words = list(tokens)
            flat, counts = self.bpe.merge_words(words)
            first = np.cumsum(counts) - counts
            good = (counts == 1) & (flat[first] == np.fromiter(tokens.values(), np.int64, len(tokens)))
            return {w: tokens[w] for w, ok in zip(words, good.tolist(), strict=True) if ok}
        return {
            w: i for w, i in tokens.items() if self.bpe.merge_long(self.bpe.inner[np.frombuffer(w, np.uint8)].tolist()) == [i]
        }

    def _by_length(self, tokens: dict[bytes, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for n in sorted({len(t) for t in tokens}):
            own = [t for t in tokens if len(t) == n]
            raw = np.frombuffer(b"".join(own), np.uint8).reshape(-1, n).astype(np.uint64) + np.uint64(1)
            h = np.zeros(len(own), dtype=np.uint64)
            for k in range(n):
                h = h * BASE + raw[:, k]
            order = np.argsort(h)
            out[n] = h[order], np.array([tokens[t] for t in own], dtype=np.int64)[order]
        return out

    def spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that uses it up) from the token down its
        right or left edge."""
        found = self.spines.get((token, right))
        if found is None:
            found, used, at = [], len(self.bpe.ranks), token
            while True:
                found.append((at, used))
                if at not in self.parts:
                    break
                a, b, used = self.parts[at]
                at = b if right else a
            self.spines[token, right] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand right after token ``a``."""
        key = a * self.bpe.size + b
        found = self.fits.get(key)
        if found is None:
            rank, size = self.bpe.rank_of, self.bpe.size
            found = True
            for x, x_used in self.spine(a, True):
                for y, y_used in self.spine(b, False):
                    r = rank.get(x * size + y)
                    # of equal pairs the left one is merged first
                    if r is not None and r < x_used and r <= y_used:
                        found = False
                        break
                if not found:
                    break
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def prefixes(self, word: bytes) -> tuple[list[int], list[int]]:
        """Tokens of each prefix (0 to all bytes): as the beginning of a
        longer word, and as a whole word."""
        n = len(word)
        count, last, whole = [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            low = max(0, end - self.longest)
            count[end], last[end] = self._step(word, low, end, self.inner, count, last)
            whole[end] = self._step(word, low, end, self.final, count, last)[0]
        return count, whole

    def _step(self, word, low, end, tokens, count, last) -> tuple[int, int]:
        fits, size = self.fits, self.bpe.size
        for start in range(low, end):
            token = tokens.get(word[start:end])
            if token is None:
                continue
            if start == 0:
                return 1, token
            before = last[start]
            ok = fits.get(before * size + token)
            if ok is None:
                ok = self.may_follow(before, token)
            if ok:
                return count[start] + 1, token
        raise ValueError("the vocabulary has no token for a byte")

    def count_words(self, words: set[str]) -> None:
        """Put the words' token counts into the cache."""
        fresh = words.difference(self.cache)
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
            fresh = words
        short, raws = [], []
        for w in fresh:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) <= ROUND_BYTES:
                short.append(w)
                raws.append(raw)
            else:
                self.cache[w] = self.prefixes(raw)[1][-1]
        if len(raws) < 100:
            self.cache.update((w, self.prefixes(r)[1][-1]) for w, r in zip(short, raws, strict=True))
            return
        for a in range(0, len(raws), ROUND_WORDS):
            found = self.count_many(raws[a : a + ROUND_WORDS])
            self.cache.update(zip(short[a : a + ROUND_WORDS], found.tolist(), strict=True))

    def count_many(self, words: list[bytes]) -> np.ndarray:
        """The same recurrence for many words at once: all prefixes of one
        length, then of the next, with tokens found by the hash of their bytes
        in the sorted hashes of the tokens of that length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        size = sizes[order]
        raw = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8).astype(np.uint64) + np.uint64(1)
        begin = np.cumsum(size) - size
        last = np.full((int(size[0]) + 1, len(words)), -1, dtype=np.int64)
        count = np.zeros((int(size[0]) + 1, len(words)), dtype=np.int32)
        out = np.zeros(len(words), dtype=np.int64)
        # head[e]: hash of the first e bytes; a stretch's is a difference of two
        head = np.zeros((int(size[0]) + 1, len(words)), dtype=np.uint64)
        for e in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -e, side="right"))  # words of e bytes or more
            head[e, :live] = head[e - 1, :live] * BASE + raw[begin[:live] + e - 1]
            more = int(np.searchsorted(-size, -e, side="left"))  # of more than e bytes
            for tables, lo, hi in ((self.inner_at, 0, more), (self.final_at, more, live)):
                open_ = np.arange(lo, hi)
                for n in range(1, min(e, self.longest) + 1):
                    if not len(open_):
                        break
                    if n not in tables:
                        continue
                    keys, ids = tables[n]
                    h = head[e, open_] - head[e - n, open_] * self.power[n]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[at] == h
                    if n < e:
                        some = np.flatnonzero(hit)
                        before = last[e - n, open_[some]]
                        hit[some] = self._fit_many(before, ids[at[some]])
                    got = open_[hit]
                    tokens = 1 + (count[e - n, got] if n < e else 0)
                    if tables is self.inner_at:
                        last[e, got], count[e, got] = ids[at[hit]], tokens
                    else:
                        out[got] = tokens
                    open_ = open_[~hit]
        back = np.empty(len(words), dtype=np.int64)
        back[order] = out
        return back

    def _fit_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs, by a sorted table of those known."""
        key = a * self.bpe.size + b
        at = np.searchsorted(self.known, key)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != key[~new]
        if new.any():
            fresh = np.unique(key[new])
            fit = [self.may_follow(*divmod(k, self.bpe.size)) for k in fresh.tolist()]
            if len(self.known) > CACHE_PAIRS:
                self.known, self.known_fit = fresh, np.array(fit)
                return self._fit_many(a, b)
            both = np.concatenate([self.known, fresh])
            order = np.argsort(both, kind="stable")
            self.known, self.known_fit = both[order], np.concatenate([self.known_fit, fit])[order]
            at = np.searchsorted(self.known, key)
        return self.known_fit[at]

    def text_counts(self, texts: list[str], want_words: bool = False) -> list[list[int]]:
        """Each text's tokens word by word (a special string is one token)."""
        bpe = self.bpe
        parts = []
        seen: set[str] = set()
        for t in texts:
            one = []
            for k, s in enumerate(bpe.segments(t)):
                if k % 2:
                    one.append(None)
                elif s:
                    one.append(bpe.words(s))
                    seen.update(one[-1])
            parts.append(one)
        self.count_words(seen)
        cache = self.cache
        return [[n for ws in one for n in ([1] if ws is None else [cache[w] for w in ws])] for one in parts]

    def truncate(self, text: str, budget: int) -> str:
        """The longest beginning of the text that has at most ``budget``
        tokens, cut between characters but not inside a special string.
        Stretches between white space are taken whole by their cached counts;
        only the first that does not fit is looked at character by character.
        """
        out, left = [], budget
        for k, s in enumerate(self.bpe.segments(text)):
            if k % 2:
                if left < 1:
                    return "".join(out)
                out.append(s)
                left -= 1
                continue
            for piece in _STRETCH.findall(s):
                n = self._tokens(piece)
                if n > left:
                    # no token has more than ``longest`` bytes
                    for cut in range(min(len(piece), left * self.longest), 0, -1):
                        if self._tokens(piece[:cut]) <= left:
                            out.append(piece[:cut])
                            break
                    return "".join(out)
                out.append(piece)
                left -= n
        return "".join(out)

    def _tokens(self, segment: str) -> int:
        words = self.bpe.words(segment)
        self.count_words(set(words))
        return sum([self.cache[w] for w in words])


def _symbol_chars(bpe: WordBpe) -> list[str]:
    return [bpe.token[i] for i in bpe.inner.tolist()]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(load(path))


def count_tokens(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    limit: int = 2048,
    keep_prefixes: bool = False,
    prefix: str = "",
) -> DataFrame:
    """``docs`` without the text and with ``n_bytes`` (UTF-8), ``n_tokens``
    and ``over_limit``; with ``keep_prefixes`` also ``ends``, the tokens up to
    the end of each word, with which any budget is answered by a search.
    Added names get ``prefix``; they must not be columns of ``docs``."""
    from pyspark.sql import functions as F

    others = [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in others] + [
        StructField(prefix + "n_bytes", LongType()),
        StructField(prefix + "n_tokens", LongType()),
    ]
    if keep_prefixes:
        fields.append(StructField(prefix + "ends", ArrayType(IntegerType())))
    names = [f.name for f in fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(others)).to_pylist()]
            for a, b in slices(texts):
                found = prefixes.text_counts(texts[a:b])
                columns = [batch.column(k).slice(a, b - a) for k in range(len(others))]
                columns.append(pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]], pa.int64()))
                columns.append(pa.array([sum(f) for f in found], pa.int64()))
                if keep_prefixes:
                    columns.append(pa.array([np.cumsum(f, dtype=np.int32) for f in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.select(*[f"`{c}`" for c in [*others, text_col]]).mapInArrow(count, StructType(fields))
    return out.withColumn(prefix + "over_limit", F.col(f"`{prefix}n_tokens`") > limit)


def truncate_documents(docs: DataFrame, path: str, budget: int, text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest beginning of at most
    ``budget`` tokens."""
    from pyspark.sql import functions as F

    @F.pandas_udf(StringType())
    def cut(texts):
        prefixes = counter(path)
        return texts.map(lambda t: prefixes.truncate(t or "", budget))

    return docs.withColumn(text_col, cut(f"`{text_col}`"))
