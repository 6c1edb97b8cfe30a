"""BPE encoding and decoding with contiguous rank arrays.

A word is held as two arrays: its parts and the ranks of adjacent parts. The minimum is found by a scan, its
right boundary is deleted, and the two neighbouring ranks are refreshed. Words of over LONG_WORD parts, for
which repeated scans would be quadratic, take the same merges from a heap.

The tokenizer file is read in each Python worker from a path that is a parameter. Null texts are empty:
no tokens, and the hash of an empty string. Rows are independent: repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame

from .arrow import Memo, map_texts

LONG_WORD = 400
MEMO_WORDS = 300_000
_NONE = 1 << 60


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files: Latin-1's printable ones stand for themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RankBpe:
    """The merges of a tokenizers file, applied to words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        #: The same by left << 32 | right, with rank << 32 | merged: plain numbers are made, hashed and compared faster than tuples.
        self.packed = {a << 32 | b: rank << 32 | new for (a, b), (rank, new) in self.pairs.items()}
        self.chars = chars = byte_chars()
        self.unit = {b: self.vocab[x] for b, x in enumerate(chars) if x in self.vocab}
        self.last = {b: self.vocab[x + self.suffix] for b, x in enumerate(chars) if x + self.suffix in self.vocab}

    def parts(self, word: str) -> list[int]:
        data, unit = word.encode("utf-8"), self.unit
        out = [unit[b] for b in data[:-1]]
        out.append(self.last[data[-1]])
        return out

    def word_ids(self, word: str) -> list[int]:
        parts = self.parts(word)
        if len(parts) > LONG_WORD:
            return self._by_heap(parts)
        get = self.packed.get
        found = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while found:
            least = min(found)
            if least == _NONE:
                break
            at = found.index(least)
            parts[at] = new = least & 0xFFFFFFFF
            del parts[at + 1], found[at]
            if at:
                found[at - 1] = get(parts[at - 1] << 32 | new, _NONE)
            if at < len(found):
                found[at] = get(new << 32 | parts[at + 1], _NONE)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or (parts[i], parts[j]) != p:
                continue
            parts[i] = pairs[p][1]
            gone[j] = 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                q = parts[i], parts[after[i]]
                if q in pairs:
                    heapq.heappush(heap, (pairs[q][0], i, q))
            if before[i] >= 0:
                q = parts[before[i]], parts[i]
                if q in pairs:
                    heapq.heappush(heap, (pairs[q][0], before[i], q))
        return [x for x, g in zip(parts, gone) if not g]


@lru_cache(1)
def rank_bpe(path: str) -> RankBpe:
    """The file is read once a worker process; memos of words end with their task."""
    return RankBpe(path)


class WordTokenizer:
    """Texts to ids and back, for files whose words are composed, lower-cased runs and whose white space is dropped."""

    #: Fixed value: what the file's pre-tokenizer keeps.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: Latin letters, punctuation.
    COMMON = "".join(map(chr, (*range(0x250), *range(0x2000, 0x2070))))

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import regex

        self.bpe = rank_bpe(path)
        self.find = regex.compile(self.PATTERN).findall
        # the same pattern with its classes spelled out for the commoner characters, for the standard library's faster matcher; texts with other characters take the one above
        listed = lambda p: "".join(map(re.escape, filter(regex.compile(p).match, self.COMMON)))
        letters, numbers, spaces = listed(r"\p{L}"), listed(r"\p{N}"), listed(r"\s")
        self.find_common = re.compile(f"{self.PATTERN.split('|[', 1)[0]}|[{letters}]+|[{numbers}]|[^{letters}{numbers}{spaces}]+").findall
        self.uncommon = re.compile("[^" + "".join(map(re.escape, self.COMMON)) + "]").search
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.bpe.special)) + ")").split if self.bpe.special else lambda t: [t]
        self.memo = Memo(self._word, memo_words)

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.bpe.word_ids(word)
        return len(ids), " ".join(map(str, ids)), " ".join(self.bpe.token[i] for i in ids)

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered on its own, without a final form of sigma
        low = text.lower()
        return self.find(low) if self.uncommon(low) else self.find_common(low)

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        """Per word: number of tokens, ids and token strings, both joined by spaces."""
        memo = self.memo
        if "<|" not in text:
            return list(map(memo.__getitem__, self.words(text)))
        out = []
        for k, piece in enumerate(self.split(text)):
            if k % 2:
                i = self.bpe.special[piece]
                out.append((1, str(i), piece))
            else:
                out += map(memo.__getitem__, self.words(piece))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for e in self.entries(text) for i in e[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: token strings are joined by spaces."""
        return " ".join(self.bpe.token[i] for i in ids)


def encode_digests(docs: DataFrame, path: str, memo_words: int = MEMO_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text; no shuffle."""

    def make():
        tok = WordTokenizer(path, memo_words)

        def of(text: str):
            e = tok.entries(text)
            ids, words = " ".join([x[1] for x in e]), " ".join([x[2] for x in e])
            return ids.count(" ") + 1 if e else 0, sha256(ids.encode()).hexdigest(), sha256(words.encode()).hexdigest()

        return of

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, memo_words: int = MEMO_WORDS) -> DataFrame:
    """doc_id and the ids as an array; `decode` is its inverse up to the file's normalisation."""

    def make():
        tok = WordTokenizer(path, memo_words)
        return lambda text: (tok.encode(text),)

    return map_texts(docs, make, "ids array<int>")
