"""Benchmark decontamination by a broadcast hash set of the test items' n-grams.

Words are runs of ASCII letters and digits or non-ASCII characters, A-Z lower-cased. A window is `n` consecutive
words of an item, or all its words if it has fewer. Any occurrence of a window of w words holds, at each place
that is a multiple of t = (w + 1) div 2, exactly one whole tile of t words. So only a document's tiles (1/t of
its places) probe the set of the items' t-grams; each hit is then verified word by word, and extended by
at most w - t words to both sides. Runs of w or more equal words are the hit spans: no window is missed.

Null texts have no words. Every row is judged and reported on its own, also rows that repeat a doc_id or have none; rows equal in
doc_id and text fare alike. Items without words are never hit. An empty benchmark or table gives rows without hits, or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .common import NON_ALNUM_CLASS, ascii_lower, by_size, fresh, words_of

WINDOW = 13
#: The items' t-grams are broadcast up to this many rows (about 100 MB); beyond it the probe is a shuffled hash join.
BROADCAST_GRAMS = 500_000
#: Hit rows are broadcast up to this many spans.
BROADCAST_ROWS = 1_000_000
_TRIM = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def norm_words(col):
    return words_of(ascii_lower(col), NON_ALNUM_CLASS, _TRIM)


def _grams(benchmark: DataFrame, n: int) -> DataFrame:
    """One row per item place: t, hash, item, the words around it (up to w - t to both sides) and how many lie before."""
    items = benchmark.select(F.col("item_id"), norm_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("w", F.least(F.lit(n), F.size("words"))).withColumn("t", F.expr("(w + 1) div 2"))
    # items with the same words are alike: they share their grams
    items = items.groupBy("words", "w", "t").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    places = items.select("ids", "w", "t", "words", F.explode(F.expr("sequence(0, size(words) - t)")).alias("q"))
    return places.select(
        "ids", "w", "t", F.expr("xxhash64(slice(words, q + 1, t))").alias("h"),
        F.expr("least(q, w - t)").alias("before"), F.expr("slice(words, q + 1 - least(q, w - t), least(q, w - t) + w)").alias("around"),
    )


def _slots(grams: DataFrame, n_grams: int):
    """A byte for each slot of the grams' hashes, 16 slots a gram and 1 MB at most, as a literal, and its length.

    It only spares the join what cannot match; a tile whose slot happens to be taken is still looked up.
    """
    n = min(1 << 20, max(1 << 12, 1 << (16 * n_grams).bit_length()))
    taken = bytearray(n)
    for r in grams.select(F.pmod("h", F.lit(n)).cast("int").alias("i")).distinct().collect():  # n rows at most
        taken[r["i"]] = 1
    return F.lit(taken), n


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_limit: int = BROADCAST_GRAMS) -> DataFrame:
    """Per row: doc_id, version (a hash of the text), n_words, spans array<struct<s,e>> (words s..e-1 are hit, disjoint, sorted), items array<string> (sorted)."""
    grams = materialize(_grams(benchmark, n), "grams")
    sizes = grams.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()  # at most (n + 1) / 2 rows
    tiles_t = sorted(r["t"] for r in sizes)
    # a number tells rows apart; it stays within this plan, in which a task that runs again gives the same ones
    words = docs.select("doc_id", F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("row"), norm_words(F.col("text")).alias("words"))
    ts = f"array({', '.join(map(str, tiles_t))})" if tiles_t else "cast(array() as array<int>)"
    small = sum(r["n"] for r in sizes) <= broadcast_limit
    slots, n_slots = _slots(grams, sum(r["n"] for r in sizes))
    # in the row: hash every tile, keep those whose slot is taken, and give these the words around them
    tile = f"flatten(transform({ts}, t -> CASE WHEN size(words) >= t THEN transform(sequence(0, size(words) - t, t), p -> named_struct('t', t, 'h', xxhash64(slice(words, p + 1, t)), 'p', p)) ELSE array() END))"
    words = words.withColumn("tiles", F.expr(tile))
    words = words.withColumn("tiles", F.filter("tiles", lambda x: F.substring(slots, F.pmod(x["h"], F.lit(n_slots)).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))))
    side = n - (n + 1) // 2
    full = f"transform(tiles, x -> named_struct('t', x.t, 'h', x.h, 'p', x.p, 'before', least(x.p, {side}), 'around', slice(words, x.p + 1 - least(x.p, {side}), least(x.p, {side}) + x.t + {side})))"
    head = "array(named_struct('t', 0, 'h', 0L, 'p', size(words), 'before', 0, 'around', cast(array() as array<string>)))"
    tiles = words.select("doc_id", "version", "row", F.inline(F.expr(f"concat({head}, {full})"))).toDF("doc_id", "version", "row", "t", "h", "p", "d_before", "d_around")
    probe = tiles.join(F.broadcast(grams) if small else grams.hint("shuffle_hash"), ["t", "h"], "left").where("t = 0 OR ids IS NOT NULL")
    # equal words to the left of the tile, the tile itself, and to the right of it
    left = "aggregate(sequence(1, least(d_before, before)), named_struct('n', 0, 'on', true), (a, k) -> named_struct('n', a.n + int(a.on AND get(d_around, d_before - k) = get(around, before - k)), 'on', a.on AND get(d_around, d_before - k) = get(around, before - k)), a -> a.n)"
    most = "least(size(d_around) - d_before, size(around) - before)"
    right = f"aggregate(sequence(0, {most} - 1), named_struct('n', 0, 'on', true), (a, k) -> named_struct('n', a.n + int(a.on AND get(d_around, d_before + k) = get(around, before + k)), 'on', a.on AND get(d_around, d_before + k) = get(around, before + k)), a -> a.n)"
    hits = probe.select("doc_id", "version", "row", "t", "p", "w", "ids", F.expr(f"CASE WHEN t > 0 THEN CASE WHEN least(d_before, before) > 0 THEN {left} ELSE 0 END END").alias("l"), F.expr(f"CASE WHEN t > 0 THEN {right} END").alias("r"))
    hits = hits.where("t = 0 OR (r >= t AND l + r >= w)")
    spans = hits.groupBy("row", "doc_id", "version").agg(
        F.max(F.expr("CASE WHEN t = 0 THEN p END")).alias("n_words"),
        F.array_sort(F.collect_set(F.expr("CASE WHEN t > 0 THEN struct(p - l AS s, p + r AS e) END"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )
    # merge overlapping spans: sorted by start, a span adds what lies beyond the furthest end so far
    merged = """aggregate(spans, named_struct('out', cast(array() as array<struct<s:int,e:int>>), 'far', 0),
        (a, x) -> named_struct('out', CASE WHEN x.e > a.far THEN concat(a.out, array(named_struct('s', greatest(x.s, a.far), 'e', x.e))) ELSE a.out END, 'far', greatest(a.far, x.e)), a -> a.out)"""
    return spans.select("doc_id", "version", "n_words", F.expr(merged).alias("spans"), "items")


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """For every row: doc_id, version, n_words, n_hit, items, spans, and whether a twentieth of its words or more is hit."""
    hits = find_hits(docs, benchmark, n)
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + (x.e - x.s))")
    out = hits.select("doc_id", "version", F.col("n_words").cast("long"), n_hit.alias("n_hit"), "items", "spans")
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "document", n: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The input's columns. remove='document' drops contaminated rows; 'span' cuts the hit words, with what follows each, out of every text."""
    if remove not in ("document", "span"):
        raise ValueError("remove is 'document' or 'span'")
    doc, version, spans = fresh(docs, "doc", "version", "spans")
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(version))
    found = report(docs, benchmark, n).where("contaminated" if remove == "document" else "n_hit > 0")
    found = by_size(found.select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("spans").alias(spans)).dropDuplicates([doc, version]), "hits", broadcast_rows, F.size(spans))
    if remove == "document":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    pieces = r"regexp_extract_all(text, '(?s)[0-9A-Za-z[^\\x00-\\x7F]]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*', 0)"
    lead = r"regexp_extract(text, '^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*', 0)"
    kept = f"concat({lead}, array_join(filter({pieces}, (x, i) -> NOT exists({spans}, v -> i >= v.s AND i < v.e)), ''))"
    return joined.select(*[F.expr(f"CASE WHEN {spans} IS NULL THEN text ELSE {kept} END").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
