"""Word seeds: hashes of words at fixed offsets, found in texts by native expressions and joined with a table of seeds.

Before anything is shuffled, positions of texts are tested against a Bloom filter of the wanted hashes. Its size follows
their number up to a fixed bound; beyond the bound more positions pass, and the join decides as before.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

FILTER_BITS = 1 << 22
PROBES = 4


def plain_words(text: Column) -> Column:
    """Words of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def with_word_hashes(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """The kept columns and ``hs``, the 64-bit hash of every word."""
    words = docs.select(*keep, plain_words(F.col(f"`{text_col}`")).alias("words"))
    return words.select(*[c for c in words.columns if c != "words"], F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))


def seed_column(offsets: tuple[int, ...], salt: int, hs: str = "hs") -> Column:
    """The hash at every place where all offsets fall inside the text."""
    span = offsets[-1] + 1
    places = F.when(F.size(hs) >= span, F.sequence(F.lit(0), F.size(hs) - span)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(salt), *[F.get(hs, i + o) for o in offsets]))


def _around(place: Column, span: int, reach: int, hs: str = "hs") -> list[Column]:
    """The word hashes from ``reach`` words before a place to ``reach`` words behind its span, and where they begin."""
    begin = F.greatest(F.lit(0), place - reach)
    return [begin.alias("begin"), F.slice(hs, begin + 1, place + span + reach - begin).alias("around")]


def all_seeds(rows: DataFrame, masks: tuple[tuple[int, ...], ...], reach: int, *keep: str, first: int = 0) -> DataFrame:
    """Every seed of every row: kept columns, ``at``, ``seed``, ``begin`` and ``around`` (of a table of patterns). Masks are
    numbered from ``first`` on, and seeds of different numbers differ."""
    parts = [rows.select(*keep, "hs", F.posexplode(seed_column(m, k)).alias("at", "seed"))
             .select(*keep, "at", "seed", *_around(F.col("at"), m[-1] + 1, reach)) for k, m in enumerate(masks, first)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _probe(h: Column, k: int, bits: int) -> Column:
    """The k-th bit number of a hash: a stretch of it, from another place each time."""
    return F.shiftrightunsigned(h, 11 * k).bitwiseAND(F.lit(bits - 1))


def bloom_filter(seeds: DataFrame) -> tuple[Column, int]:
    """A Bloom filter of column ``seed`` as a literal array of 64-bit words, and its number of bits.

    At most ``FILTER_BITS`` bits, whatever the number of seeds, so that what reaches the driver is bounded.
    """
    n = seeds.agg(F.approx_count_distinct("seed")).first()[0]
    bits = min(FILTER_BITS, max(1 << 10, 1 << (64 * max(1, n) - 1).bit_length()))
    numbers = seeds.select(F.explode(F.array(*[_probe(F.col("seed"), k, bits) for k in range(PROBES)])).alias("bit"))
    words = numbers.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    table = [0] * (bits // 64)
    for r in words:
        table[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), bits


def in_filter(h: Column, table: Column, bits: int) -> Column:
    hit = None
    for k in range(PROBES):
        bit = _probe(h, k, bits)
        word = F.get(table, F.shiftright(bit, 6).cast("int"))
        one = F.call_function("getbit", word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        hit = one if hit is None else hit & one
    return hit


def found_seeds(rows: DataFrame, masks: tuple[tuple[int, ...], ...], table: Column, bits: int, reach: int,
                *keep: str, first: int = 0) -> DataFrame:
    """The seeds of each row that pass the filter: kept columns, ``at``, ``seed``, ``begin`` and ``around``.

    Seeds are a column of their own and are looked at by place, since a lambda would compute them again per element. Only
    the few that pass become rows.
    """
    for k, m in enumerate(masks, first):
        rows = rows.withColumn(f"seeds{k}", seed_column(m, k))
    return rows.select(*keep, F.inline(F.concat(*[passing(f"seeds{k}", m[-1] + 1, table, bits, reach) for k, m in enumerate(masks, first)])))


def passing(seeds: str, span: int, table: Column, bits: int, reach: int) -> Column:
    places = F.when(F.size(seeds) > 0, F.sequence(F.lit(0), F.size(seeds) - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda i: in_filter(F.get(seeds, i), table, bits))
    return F.transform(hits, lambda i: F.struct(i.alias("at"), F.get(seeds, i).alias("seed"), *_around(i, span, reach)))
