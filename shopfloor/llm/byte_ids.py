"""Ids of a byte-level BPE file, equal to the tokenizers library's.

A token never reaches across a single space that is followed by something
other than white space, so texts are cut there, and each distinct stretch of a
batch is encoded once, all of them as one long text that is cut again by the
tokens' bytes.  The long text is encoded by tiktoken's merges over the file's
own vocabulary, which is several times faster than the tokenizers library and
gives the same ids where every token's number follows the order of the merges
(checked when the file is read; tests compare the two on every character).
Texts with irregular white space or a special string, and files of another
kind, go to the tokenizers library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shopfloor.llm.bpe import byte_symbols

#: Unicode white space, as byte-level files take it, for RE2.
_BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Fixed value: the pattern that byte-level pre-tokenisers cut text by.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a file's pre-tokeniser must be for that.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class ByteIds:
    """The ids of texts under one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        self.odd = f" [{_BLANK}]| $" + "".join(f"|{re.escape(t)}" for t in special)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        self.quick = (
            not spec["normalizer"] and not spec["post_processor"]
            and all(before.get(k) == v for k, v in _BYTE_LEVEL.items())
            and None not in made and all(a < b for a, b in zip(made, made[1:], strict=False))
        )
        if self.quick:
            import tiktoken

            code = {c: b for b, c in enumerate(byte_symbols())}
            ranks = {bytes(code[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            self.merger = tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.bytes[list(ranks.values())] = [len(t) for t in ranks]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, by the tokenizers library."""
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, text: str) -> np.ndarray:
        """The ids of a regular text."""
        return self.merger.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each after a space, and how many each has."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        words = words.cast(pa.large_string())
        one = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
        ids = self.merged(" " + pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py())
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1, prepend=0)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after the other, and how
        many each has; with ``end``, that id after each text."""
        texts = pc.fill_null(texts, "")
        odd = np.ones(len(texts), bool)
        if self.quick and len(texts):
            odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        offsets, values = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
        first = np.zeros(len(values), bool)
        first[offsets[:-1]] = True
        # the distinct pieces: texts' beginnings, words after a space, whole odd texts, the end
        heads = values.filter(pa.array(first)).dictionary_encode()
        tails = values.filter(pa.array(~first)).dictionary_encode()
        odd_at = np.flatnonzero(odd)
        alone = [self.merged(t) for t in heads.dictionary.to_pylist()]
        others = self.whole([texts[i].as_py() for i in odd_at.tolist()])
        ids, count = self.spaced(tails.dictionary)
        known = np.concatenate([*alone, ids, *others, np.array([end or 0], dtype="<u4")])
        counts = np.concatenate([[len(x) for x in alone], count, [len(x) for x in others], [1]]).astype(np.int64)
        # the texts as lists of pieces
        sizes = np.ones(len(texts), dtype=np.int64)
        sizes[~odd] = np.diff(offsets)
        order, regular = np.empty(int(sizes.sum()), dtype=np.int64), np.repeat(~odd, sizes)
        piece = np.empty(len(values), dtype=np.int64)
        piece[first], piece[~first] = heads.indices.to_numpy(), tails.indices.to_numpy() + len(alone)
        order[regular], order[~regular] = piece, len(alone) + len(count) + np.arange(len(odd_at))
        if end is not None:
            order, sizes = np.insert(order, np.cumsum(sizes), len(counts) - 1), sizes + 1
        pieces = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), pa.array(known))
        ends = np.append(0, np.cumsum(counts[order]))[np.append(0, np.cumsum(sizes))]
        return pieces.take(pa.array(order)).flatten().to_numpy(), np.diff(ends)


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    """The vocabulary, once in each Python worker."""
    return ByteIds(path)
