"""Language identification of words in code-switched text by a linear-chain conditional random field.

Emissions are sums of weights of hashed features (affixes, letter n-grams, whole words, membership in the lexicons of
the training sample); transitions between languages are learned with them. Forward-backward gives each
word's marginals; a text's language is the one with the largest sum of marginals, its score that sum's share.

A chain is a whole text, whatever its length. Blocks of CHAIN words of many texts are passed together: each block's
transfer matrix first, then what enters and leaves each block along its text, and with these the blocks' words, so marginals are
those of the undivided chain. The model is fitted on the driver from a bounded sample: of the MAX_LANGS languages with the most labelled rows
SAMPLE_DOCS documents each (the smallest by a hash of the id), DOC_WORDS words of each document at most, and TRAIN_WORDS words in all (TRAIN_CELLS / languages, if that is less); training chains
join stretches of different documents, which is where transitions are learned from.

Null texts and texts without a letter give `und` and score 0. Equal sums go to the first language by name. Without
any labelled row everything is `und`. Rows are independent: repeated rows give repeated results.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .arrow import slices, trimmed
from .setsketch import mix

CHAIN = 128
SAMPLE_DOCS = 150
MAX_LANGS = 200
#: Words of a training document that reach the driver, and characters for each of them at most.
DOC_WORDS, WORD_CHARS = 5_000, 40
TRAIN_WORDS = 300_000
#: Words times languages of the fit, and numbers that a worker holds for the chains of a group of texts (8 bytes each; one text alone may need more).
TRAIN_CELLS, CHAIN_CELLS = 12_000_000, 16_000_000
EPOCHS = 40
BITS = 16
MEMO_WORDS = 200_000
#: New words whose features are hashed together; bounds the memory of a worker.
WORDS_AT_ONCE = 20_000
UNKNOWN = "und"
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def letters(token: str) -> str:
    """The word that a token holds: its letters, lower-cased."""
    token = token.lower()
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # features by languages
    moves: np.ndarray  # from, to; log
    start: np.ndarray  # log
    lexicon: dict[str, str] = field(default_factory=dict)  # word to the languages that know it

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, feature) of all words at once: hashes of substrings by prefix sums over the letters."""
        codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32)
        n, last = len(codes), np.flatnonzero(codes == ord("$"))
        first = np.concatenate([[0], last[:-1] + 1])
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, p, np.uint64)])) for p in (_P, _P_INVERSE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up[:n])])
        number = np.arange(len(words))
        inner = codes != ord("$")
        two = np.flatnonzero(inner)
        three = two[inner[two + 1]]
        of = np.cumsum(codes == ord("^")) - 1
        spans = [(number, first + 1, last)]
        spans += [(number, first, np.minimum(first + k, last + 1)) for k in (2, 3, 4)] + [(number, np.maximum(last + 1 - k, first), last + 1) for k in (2, 3, 4)]
        spans += [(of[two], two, two + 2), (of[three], three, three + 3)]
        out = [mix((sums[e] - sums[s]) * down[s] + np.uint64(kind)) for kind, (_, s, e) in enumerate(spans, 1)]
        known = np.fromiter((zlib.crc32(self.lexicon.get(w, "").encode()) for w in words), np.uint64, len(words))
        mask = np.uint64((1 << BITS) - 1)
        return np.concatenate([*(w for w, _, _ in spans), number]), (np.concatenate([*out, mix(known)]) & mask).astype(np.int64)

    def emissions(self, words: list[str]) -> np.ndarray:
        k = len(self.langs)
        if not words:
            return np.zeros((0, k), np.float32)
        if len(words) > WORDS_AT_ONCE:
            return np.concatenate([self.emissions(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)])
        owner, feature = self.features(words)
        return np.stack([np.bincount(owner, self.weights[feature, c], len(words)) for c in range(k)], axis=1).astype(np.float32)

    def marginals(self, emit: np.ndarray, sizes: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """emit: chains by places by languages, chains sorted by size, longest first; marginals of words, expected moves, log norms.

        enter, leave: what comes into each chain's first word from the left, and into its last word from the right, where it is part of a longer one.
        """
        n, length, k = emit.shape
        move = np.exp(self.moves)
        top = emit.max(axis=2, keepdims=True)
        e = np.exp(emit - top)
        alpha, scale = np.zeros_like(e), np.ones((n, length))
        live = np.searchsorted(-sizes, -np.arange(length), side="left")  # chains longer than t
        for t in range(length):
            m = live[t]
            a = ((np.exp(self.start) if enter is None else enter) if t == 0 else alpha[:m, t - 1] @ move) * e[:m, t]
            scale[:m, t] = a.sum(axis=1)
            alpha[:m, t] = a / scale[:m, t, None]
        beta, expected = np.ones_like(e), np.zeros((k, k))
        if leave is not None:
            beta[np.arange(n), sizes - 1] = leave
        for t in range(length - 2, -1, -1):
            m = live[t + 1]
            b = e[:m, t + 1] * beta[:m, t + 1] / scale[:m, t + 1, None]
            expected += (alpha[:m, t].T @ b) * move
            beta[:m, t] = b @ move.T
        words = np.arange(length)[None, :] < sizes[:, None]
        gamma = alpha * beta * words[:, :, None]
        if leave is not None:
            gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300)
        return gamma, expected, (np.log(scale) + top[:, :, 0]).sum(axis=1, where=words)

    def borders(self, emit: np.ndarray, sizes: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(enter, leave) of blocks as in `marginals`; begin: their places in the order of all words, owner: their texts.

        A block's matrix takes its first word's states to its last one's. What enters a text's blocks follows from left to right, what leaves
        them from right to left, for the blocks of all texts with as many before them at once.
        """
        n, length, k = emit.shape
        enter, leave = np.tile(np.exp(self.start), (n, 1)), np.ones((n, k))
        order = np.argsort(begin)
        new = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
        first = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))  # of a block in its text
        if not place.any():
            return enter, leave
        many = np.zeros(n, bool)
        many[order] = np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n)))
        rows = np.flatnonzero(many)  # still longest first
        move = np.exp(self.moves)
        e = np.exp(emit[rows] - emit[rows].max(axis=2, keepdims=True))
        live = np.searchsorted(-sizes[rows], -np.arange(length), side="left")
        matrix = np.tile(np.eye(k), (len(rows), 1, 1))
        for t in range(1, length):
            m = live[t]
            if not m:
                break
            x = (matrix[:m] @ move) * e[:m, t, None, :]
            matrix[:m] = x / x.sum(axis=(1, 2), keepdims=True)
        at = np.full(n, -1)
        at[rows] = np.arange(len(rows))
        by_place = [order[place == j] for j in range(place.max() + 1)]
        follows = [np.flatnonzero(place == j) for j in range(place.max() + 1)]
        for j in range(1, len(by_place)):
            before = order[follows[j] - 1]
            a = np.einsum("ni,nij->nj", enter[before] * e[at[before], 0], matrix[at[before]])
            enter[by_place[j]] = a / a.sum(axis=1, keepdims=True) @ move
        for j in range(len(by_place) - 1, 0, -1):
            mine = by_place[j]
            c = e[at[mine], 0] * np.einsum("nij,nj->ni", matrix[at[mine]], leave[mine])
            back = c @ move.T
            leave[order[follows[j] - 1]] = back / back.sum(axis=1, keepdims=True)
        return enter, leave


def to_chains(codes: np.ndarray, owners: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of at most `chain` words of one owner as a padded array, longest first; sizes; where each begins."""
    if not len(codes):
        return np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[True], owners[1:] != owners[:-1]])
    begin = np.flatnonzero(first)
    place = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
    cut = np.flatnonzero(place % chain == 0)
    sizes = np.diff(np.append(cut, len(codes)))
    order = np.argsort(-sizes, kind="stable")
    cut, sizes = cut[order], sizes[order]
    at = cut[:, None] + np.arange(sizes[0])[None, :]
    inside = np.arange(sizes[0])[None, :] < sizes[:, None]
    return np.where(inside, codes[np.minimum(at, len(codes) - 1)], 0), sizes, cut


def fit(rows: list[tuple[str, str]], train_words: int = TRAIN_WORDS, epochs: int = EPOCHS, seed: int = 7) -> Crf | None:
    """rows: (text, language) of the sample."""
    rng = random.Random(seed)
    by = defaultdict(list)
    for text, lang in rows:
        words = [w for w in map(letters, text.split()) if w]
        if words:
            by[lang].append(words)
    langs = sorted(by)
    if not langs:
        return None
    k = len(langs)
    train_words = min(train_words, TRAIN_CELLS // k)  # the arrays of the fit have a number for each word and language
    counts = {lang: Counter(w for d in by[lang] for w in d) for lang in langs}
    known = defaultdict(list)
    for lang in langs:
        for w, n in counts[lang].items():
            if n >= 3:
                known[w].append(lang)
    crf = Crf(langs, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k), {w: " ".join(x) for w, x in known.items()})
    # stretches of documents, each language with an equal share, mixed to chains
    parts = []
    for c, lang in enumerate(langs):
        left = train_words // k
        for words in rng.sample(by[lang], len(by[lang])):
            at = 0
            while at < len(words) and left > 0:
                n = rng.randint(4, 60)
                parts.append((c, words[at : at + n]))
                left -= n
                at += n
    rng.shuffle(parts)
    words = [w for _, p in parts for w in p]
    labels = np.array([c for c, p in parts for _ in p])
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words])
    owner, flat = crf.features(list(ids))
    block = np.arange(len(codes)) // CHAIN
    grid, lengths, _ = to_chains(np.arange(len(codes)), block)
    inside = np.arange(grid.shape[1])[None, :] < lengths[:, None]
    y = labels[grid]
    seen_moves = np.zeros((k, k))
    both = inside[:, 1:] if grid.shape[1] > 1 else inside[:, :0]
    np.add.at(seen_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
    seen_start = np.bincount(y[:, 0], minlength=k).astype(float)
    params = [crf.weights, crf.moves, crf.start]
    m1, m2 = [np.zeros_like(p, dtype=np.float64) for p in params], [np.zeros_like(p, dtype=np.float64) for p in params]
    for step in range(1, epochs + 1):
        emit = np.stack([np.bincount(owner, crf.weights[flat, c], len(ids)) for c in range(k)], axis=1)[codes]
        gamma, expected, _ = crf.marginals(emit[grid].astype(np.float64), lengths)
        rest = np.zeros((len(codes), k))
        rest[grid[inside]] = gamma[inside]
        rest[np.arange(len(codes)), labels] -= 1
        per_word = np.stack([np.bincount(codes, rest[:, c], len(ids)) for c in range(k)], axis=1)
        g = np.stack([np.bincount(flat, per_word[owner, c], 1 << BITS) for c in range(k)], axis=1)
        grads = [g / len(codes) + 1e-7 * crf.weights, (expected - seen_moves) / len(codes), (gamma[:, 0].sum(axis=0) - seen_start) / len(codes)]
        for p, d, a, b in zip(params, grads, m1, m2):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return crf


class Tagger:
    """A model with its memo of words' emissions, for one Python worker."""

    def __init__(self, crf: Crf, memo_words: int = MEMO_WORDS):
        self.crf, self.limit = crf, memo_words
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(crf.langs)), np.float32)

    def tag(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Tokens with letters per text; and for all of them, in order: owner, marginals. Last: summed marginals per text."""
        if len(self.rows) > self.limit:
            self.rows, self.table = {}, self.table[:0]
        tokens = [t.split() for t in texts]
        new = list({w for x in tokens for w in x}.difference(self.rows))
        plain = [letters(w) for w in new]
        fresh = [(w, p) for w, p in zip(new, plain) if p]
        for w, p in zip(new, plain):
            if not p:
                self.rows[w] = -1
        at = len(self.table)
        self.table = np.concatenate([self.table, self.crf.emissions([p for _, p in fresh])])
        for i, (w, _) in enumerate(fresh):
            self.rows[w] = at + i
        get = self.rows.__getitem__
        codes = np.fromiter((c for x in tokens for c in map(get, x)), np.int64)
        owners = np.repeat(np.arange(len(texts)), [len(x) for x in tokens])
        real = codes >= 0
        codes, owners = codes[real], owners[real]
        grid, sizes, begin = to_chains(np.arange(len(codes)), owners)
        marginals = np.zeros((len(codes), len(self.crf.langs)))
        if len(codes):
            inside = np.arange(grid.shape[1])[None, :] < sizes[:, None]
            emit = self.table[codes][grid].astype(np.float64)
            gamma, _, _ = self.crf.marginals(emit, sizes, *self.crf.borders(emit, sizes, begin, owners[begin]))
            marginals[grid[inside]] = gamma[inside]
        sums = np.stack([np.bincount(owners, marginals[:, c], len(texts)) for c in range(len(self.crf.langs))], axis=1)
        return tokens, owners, marginals, sums

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        _, _, _, sums = self.tag(texts)
        total = sums.sum(axis=1)
        best = sums.round(9).argmax(axis=1)
        score = np.divide(sums[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
        return [self.crf.langs[b] if n > 0 else UNKNOWN for b, n in zip(best, total)], np.clip(score, 0, 1).tolist()

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """(token, language, probability) of every token that has a letter."""
        tokens, _, marginals, _ = self.tag([text])
        kept = [w for w in tokens[0] if self.rows[w] >= 0]
        return [(w, self.crf.langs[m.argmax()], float(m.max())) for w, m in zip(kept, marginals)]


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, train_words: int = TRAIN_WORDS, epochs: int = EPOCHS, max_langs: int = MAX_LANGS, doc_words: int = DOC_WORDS) -> Crf | None:
    """Fit on the labelled rows that are not held out; only the sample reaches the driver: max_langs * sample_docs * doc_words words at most."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull())
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang")
    nth = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").join(F.broadcast(langs), "lang", "left_semi")
    ids = ids.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= sample_docs).select("doc_id", "lang").distinct()
    # sample_docs rows per language at most; of rows that share an id the first texts count
    words = F.slice(F.split(F.trim("text"), r"\s+"), 1, doc_words)
    text = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(WORD_CHARS))), " ").alias("text")
    sample = docs.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").where(F.col("text").isNotNull()).select("doc_id", "lang", text)
    again = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = sample.withColumn("nth", F.row_number().over(again)).where(F.col("nth") <= sample_docs)
    found = sorted((r["doc_id"], r["text"], r["lang"]) for r in sample.collect())
    return fit([(t, lang) for _, t, lang in found], train_words, epochs)


def _groups(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose chains stay within CHAIN_CELLS: about eight numbers for each word and language, and languages squared for each block of words."""
    most = CHAIN_CELLS // (8 * k + k * k // CHAIN)  # words
    for part in slices(batches):
        words = np.cumsum(pc.fill_null(pc.binary_length(part.column(2)), 0).to_numpy() // 4 + 1)  # a guess, mostly too high
        at = 0
        while at < part.num_rows:
            end = max(at + 1, int(np.searchsorted(words, (words[at - 1] if at else 0) + most, side="right")))
            yield part.slice(at, end - at)
            at = end


def identify(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; no shuffle."""
    base = docs.select("doc_id", held_out().alias("held_out"), "text")
    if crf is None:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    out = StructType([*base.schema[:2].fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        tagger = Tagger(shared.value)
        for part in _groups(batches, len(shared.value.langs)):
            langs, scores = tagger.predict([t or "" for t in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return base.mapInArrow(trimmed(run), out)
