"""Token counts by a finite-state transducer that is compiled, state by state, from a byte-level BPE file.

Why a finite state is enough. A BPE encoding is the only sequence of tokens in which each adjacent pair stays apart when it
is encoded alone. So the last token of a prefix w[:i+1] is the one token t = w[j:i+1] that stays apart from the last token
of w[:j]. Such a t begins at a place j whose rest w[j:i] begins some token. A state is therefore the longest
such rest, and for each such place the last token and the token count relative to the present one; nothing else of the
past matters. Transitions carry the change of the count. They are made when they are first met, and forgotten together
when the table is full, so memory is bounded and results are exact. Whole words met before are arcs of their own.

Splitting text into words is a transducer too: Machine has a mode (inside a run of letters, of digits, of other signs, of white
space, or after an apostrophe), the few characters whose reading is still open, and the state within the present word.

Long texts are cut into chunks, also inside words. A chunk's map is a table of (entry state, exit state, count). Each chunk
is first mapped for one entry, which is guessed from the characters before it; where the exit of a chunk is no
entry of the next one's map yet, that entry is added, until every exit is met. Maps then compose pairwise, in a parallel prefix scan over tables: joined
exit to entry, blocks of two chunks, of four, and so on, so a text of n chunks takes log2(n) joins.

Null texts are empty: 0 tokens. Rows are independent: repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .arrow import Memo, map_texts, slices, trimmed
from .bpe import RankBpe

CHUNK_CHARS = 1 << 16
#: Characters before a chunk from which its entry is guessed; any number gives the same counts.
BEFORE = 64
MEMO_WORDS = 250_000
MAX_ARCS = 400_000
#: Fixed value: how the file splits text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class CountTransducer:
    """States are numbers; arcs map state * 256 + byte to (state, change of the count)."""

    def __init__(self, bpe: RankBpe, max_arcs: int = MAX_ARCS):
        self.bpe, self.max_arcs = bpe, max_arcs
        byte_of = {c: b for b, c in enumerate(bpe.chars)}
        raw = {t: bytes(byte_of[c] for c in t) for t in bpe.vocab if t not in bpe.special}
        self.ids = {r: bpe.vocab[t] for t, r in raw.items()}
        # a token that its own text does not give can never be met
        self.ids = {r: i for r, i in self.ids.items() if len(r) == 1 or self._units(r) == [i]}
        self.bytes = {i: r for r, i in self.ids.items()}
        self.begins = {r[:k] for r in self.ids for k in range(len(r))}
        self.apart: dict[tuple[int, int], bool] = {}
        self._forget()

    def _units(self, raw: bytes) -> list[int]:
        bpe = self.bpe
        parts = [bpe.vocab[bpe.chars[b]] for b in raw]
        pairs = bpe.pairs
        while True:
            best = min(((pairs[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in pairs), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [pairs[parts[k], parts[k + 1]][1]]

    def _forget(self) -> None:
        # the start: no rest, no last token, count 0
        start = (b"", ((-1, 0),))
        self.keys, self.numbers, self.arcs = [start], {start: 0}, {}
        self.apart.clear()

    def _stays_apart(self, a: int, b: int) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            known = self.apart[a, b] = self._units(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        """rest: the longest live rest; places[k]: the last token before rest[k:], and its count less the present count."""
        rest, places = self.keys[state]
        text = rest + bytes((byte,))
        for k, (last, count) in enumerate(places):
            if last == -2:  # no token begins here
                continue
            token = self.ids.get(text[k:])
            if token is not None and (last == -1 or self._stays_apart(last, token)):
                break
        change = count + 1
        grown = [(last, n - change) if last != -2 else (-2, 0) for last, n in places] + [(token, 0)]
        live = [g if text[i:] in self.begins else (-2, 0) for i, g in enumerate(grown)]
        cut = next(i for i, g in enumerate(live) if g[0] != -2)  # the empty rest is always live
        arc = self.arcs[state << 8 | byte] = (self.number((text[cut:], tuple(live[cut:]))), change)
        return arc

    def number(self, key: tuple) -> int:
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.keys)
            self.keys.append(key)
        return n

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """(state, change of the count), as `count` follows them; a full table is forgotten, but for the state at hand."""
        if len(self.arcs) > self.max_arcs:
            key = self.keys[state]
            self._forget()
            state = self.number(key)
        return self.arcs.get(state << 8 | byte) or self._arc(state, byte)

    def count(self, word: str) -> int:
        if len(self.arcs) > self.max_arcs:
            self._forget()
        arcs, state, total = self.arcs, 0, 0
        for b in word.encode("utf-8"):
            arc = arcs.get(state << 8 | b) or self._arc(state, b)
            state = arc[0]
            total += arc[1]
        return total


@lru_cache(1)
def _transducer(path: str, max_arcs: int) -> CountTransducer:
    """One a worker process, whatever the number of its tasks."""
    return CountTransducer(RankBpe(path), max_arcs)


@lru_cache(1)
def counter(path: str, memo_words: int = MEMO_WORDS, max_arcs: int = MAX_ARCS) -> Counter:
    return Counter(path, memo_words, max_arcs)


class Counter:
    """Counts of whole texts, word by word, with a memo of words."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, max_arcs: int = MAX_ARCS):
        import regex

        self.transducer = _transducer(path, max_arcs)
        self.find = regex.compile(PATTERN).findall
        self.special = [*self.transducer.bpe.special]
        self.split = re.compile("|".join(map(re.escape, self.special))).split
        self.memo = Memo(self.transducer.count, memo_words)

    def count(self, text: str) -> int:
        get = self.memo.__getitem__
        if not any(s in text for s in self.special):
            return sum(map(get, self.find(text)))
        pieces = self.split(text)
        return len(pieces) - 1 + sum(sum(map(get, self.find(p))) for p in pieces)


#: The state at the beginning of a text, as it is written into tables.
START = json.dumps(["S", "", "", None])


class Machine:
    """The transducer of whole texts. A state is its mode, the characters that are still open, the begun special token, and the state inside the present word.

    Modes: S between words, L, N, O in a run of letters, digits or other signs, W in white space (its last character is
    open), A after an apostrophe that may begin a contraction.
    """

    CLOSED = ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll")  # the contractions of PATTERN

    def __init__(self, counter: Counter):
        import regex

        self.counter, self.words = counter, counter.transducer
        self.kinds = [(regex.compile(p).match, k) for p, k in ((r"\s", "W"), (r"\p{L}", "L"), (r"\p{N}", "N"))]
        self.kind: dict[str, str] = {}
        self.bound = regex.compile(r"(?<=\S)\s").finditer

    def _kind(self, c: str) -> str:
        k = self.kind.get(c)
        if k is None:
            k = self.kind[c] = next((k for match, k in self.kinds if match(c)), "O")
        return k

    def _enter(self, state: str) -> None:
        self.mode, self.open, self.begun, inner = json.loads(state)
        self.total = 0
        self.inner = 0 if inner is None else self.words.number((inner[0].encode("latin-1"), tuple(map(tuple, inner[1]))))

    def _exit(self) -> str:
        rest, places = self.words.keys[self.inner]
        return json.dumps([self.mode, self.open, self.begun, [rest.decode("latin-1"), places] if self.inner else None])

    def _feed(self, c: str) -> None:
        for b in c.encode("utf-8"):
            self.inner, change = self.words.arc(self.inner, b)
            self.total += change

    def _word(self, text: str) -> None:
        """A whole word ends what stands before it and itself."""
        self.inner = 0
        self._feed(text)
        self.inner = 0

    def _end(self) -> None:
        """What is open is read as it is at the end of a text."""
        if self.mode == "W":
            self._feed(self.open)
        elif self.mode == "A":
            self._word(self.open[0])
            if self.open[1:]:
                self._word(self.open[1:])
        self.mode, self.open, self.inner = "S", "", 0

    def _step(self, c: str) -> None:
        kind = self._kind(c)
        if self.mode == "A":
            both = self.open + c
            if both in self.CLOSED:
                self._word(both)
                self.mode, self.open = "S", ""
                return
            if any(x.startswith(both) for x in self.CLOSED):
                self.open = both
                return
            sign, letter = self.open[0], self.open[1:]
            self.inner = 0
            self._feed(sign)
            self.mode, self.open = "O", ""
            if letter:
                self.inner = 0
                self._feed(letter)
                self.mode = "L"
        elif self.mode == "W":
            if kind == "W":
                self._feed(self.open)
                self.open = c
                return
            last, self.open, self.inner = self.open, "", 0
            if last == " ":
                self._feed(" " + c)
                self.mode = kind
                return
            self._word(last)
            self.mode = "S"
        if self.mode == kind:
            self._feed(c)
            return
        self.inner = 0
        if kind == "W":
            self.mode, self.open = "W", c
        elif c == "'":
            self.mode, self.open = "A", c
        else:
            self.mode = kind
            self._feed(c)

    def _chars(self, text: str) -> None:
        special = self.counter.special
        for c in text:
            self.begun += c
            while self.begun:
                if self.begun in special:
                    self._end()
                    self.total += 1
                    self.begun = ""
                elif any(s.startswith(self.begun) for s in special):
                    break
                else:
                    first, self.begun = self.begun[0], self.begun[1:]
                    self._step(first)

    def run(self, state: str, text: str) -> tuple[str, int]:
        """(exit state, tokens counted on the way); white space after anything else ends a word whatever came before."""
        self._enter(state)
        places = [m.start() for m in self.bound(text)] if not any(re.search(r"\s", s) for s in self.counter.special) else []
        if places:
            first, last = places[0], places[-1]
            self._chars(text[:first])
            head = self.total + self.finish(self._exit()) + self.counter.count(text[first:last])
            self._enter(START)
            self.total, text = head, text[last:]
        self._chars(text)
        return self._exit(), self.total

    def finish(self, state: str) -> int:
        """Tokens that the end of the text adds."""
        self._enter(state)
        for c in self.begun:
            self._step(c)
        self._end()
        return self.total


def _run_maps(rows: DataFrame, path: str, memo_words: int, max_arcs: int) -> DataFrame:
    """(row, k, entry, before, text) -> (row, k, entry, exit, n): one line of a chunk's map. A null entry is guessed from the characters before."""

    def run(batches):
        machine = Machine(counter(path, memo_words, max_arcs))
        for part in slices(batches):
            out = []
            for entry, before, text in zip(*(part.column(c).to_pylist() for c in ("entry", "before", "text"))):
                entry = entry or machine.run(START, before)[0]
                out.append((entry, *machine.run(entry, text)))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64())))], names=["row", "k", "entry", "exit", "n"])

    return rows.select("row", "k", "entry", "before", "text").mapInArrow(trimmed(run), "row long, k long, entry string, exit string, n long")


def _chunk_maps(chunks: DataFrame, path: str, memo_words: int, max_arcs: int) -> DataFrame:
    """The chunks' maps, closed: every exit of a chunk is an entry of the next one."""
    guess = F.when(F.col("k") == 0, F.lit(START))
    maps = materialize(_run_maps(chunks.withColumn("entry", guess).repartition("row", "k"), path, memo_words, max_arcs), "chunk-maps")
    while True:
        asked = maps.select("row", (F.col("k") + 1).alias("k"), F.col("exit").alias("entry")).distinct()
        new = asked.join(maps, ["row", "k", "entry"], "left_anti").join(chunks, ["row", "k"])
        new = materialize(_run_maps(new, path, memo_words, max_arcs), "chunk-maps")
        if not new.limit(1).count():
            return maps
        maps = materialize(maps.unionByName(new), "chunk-maps")


def _scan(maps: DataFrame) -> DataFrame:
    """(row, exit, n) of whole texts: blocks of 1, 2, 4, ... chunks are joined exit to entry."""
    longest = maps.agg(F.max("k")).first()[0] or 0
    while longest:
        left = maps.where("k % 2 = 0")
        right = maps.where("k % 2 = 1").select("row", (F.col("k") - 1).alias("k"), F.col("entry").alias("exit"), F.col("exit").alias("exit2"), F.col("n").alias("n2"))
        both = left.join(right, ["row", "k", "exit"], "left")
        maps = materialize(both.select("row", F.expr("k div 2").alias("k"), "entry", F.coalesce("exit2", "exit").alias("exit"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "block-maps")
        longest //= 2
    return maps.where(F.col("entry") == START).select("row", "exit", "n")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk_chars: int = CHUNK_CHARS, memo_words: int = MEMO_WORDS, max_arcs: int = MAX_ARCS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    Texts within one chunk need no shuffle. Longer ones are dealt out by chunk and put together from the chunks' maps.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes"))

    def whole():
        of = counter(path, memo_words, max_arcs).count
        return lambda text: (of(text),)

    short = map_texts(rows.where(F.length("text") <= chunk_chars), whole, "n_tokens long", ("doc_id", "n_bytes"))
    # the row number tells repeated rows apart; it is written down
    long = rows.where(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id())
    cut = f"transform(sequence(0, (length(text) - 1) div {chunk_chars}), k -> named_struct('k', bigint(k), 'before', substring(text, greatest(1, int(k * {chunk_chars} + 1 - {BEFORE})), least({BEFORE}, int(k * {chunk_chars}))), 'text', substring(text, int(k * {chunk_chars} + 1), {chunk_chars})))"
    chunks = materialize(long.select("doc_id", "n_bytes", "row", F.inline(F.expr(cut))), "chunks")
    ends = _scan(_chunk_maps(chunks, path, memo_words, max_arcs))

    def finish(batches):
        machine = Machine(counter(path, memo_words, max_arcs))
        for part in slices(batches):
            n = [n + machine.finish(e) for e, n in zip(part.column("exit").to_pylist(), part.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n, pa.int64())], names=["row", "n_tokens"])

    total = ends.mapInArrow(trimmed(finish), "row long, n_tokens long")
    joined = chunks.where("k = 0").join(total, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)
