"""Phrase collocations: n-grams counted by Rabin-Karp fingerprints that carry pointers to where they stand.

1. Texts are numbered and written once. In each slice of texts numpy finds words and pieces by bytes; with word hashes h and a
   fixed odd base B, the sums S[i] = h[0] + h[1] B + ... + h[i-1] B^(i-1) give every n-gram as (S[i+n] - S[i]) / B^i, modulo 2^64.
   Each different n-gram of a slice becomes one row: fingerprint, number, and pointer (text, place) to its first occurrence; all
   occurrences in the slice are compared with that one word by word, and differing ones become rows of their own.
2. A shuffle adds up the rows of a fingerprint. Words and pairs go first; of longer n-grams only those whose pairs are all
   frequent are counted, which a bit table of bounded size tells (its errors only let more through).
3. Rows of frequent fingerprints follow their pointers into the texts and become phrases, which are added up as text: two
   phrases that share a fingerprint part here. Rare phrases are never written out.
4. Cuts, containment and ranks are joins and aggregates over frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from retenta.llm.arrow import hashed, slices
from retenta.llm.substrings import _filter_of, _in_filter
from retenta.session import stage

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, COVERED = 2_000_000, 80
UNKNOWN = "und"
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Local groups whose best phrases are found first, so that a language is ranked from few rows.
SALTS = 64
_KIND = np.zeros(256, dtype=np.uint8)           # 0 inside a word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(1 << max(16, n.bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            known = _POWERS[base] = np.multiply.accumulate(steps)
    return known[:n]


class Slice:
    """Words of a run of texts: ``codes`` (number in ``vocabulary``), ``text`` and ``place`` (which text, which word in it) and
    ``piece`` (equal for words of one piece)."""

    def __init__(self, texts: pa.Array, languages: pa.Array):
        low = pc.ascii_lower(texts).cast(pa.binary())
        joined = pa.array([b"\n".join([*low.to_pylist(), b""])], pa.binary())
        data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[:pc.binary_length(joined[0]).as_py()]
        kind = _KIND[data]
        inside = kind == 0
        begins = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
        lengths = np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1 - begins
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary
        self.piece = np.cumsum(kind == 2)[begins]
        sizes = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.text = np.searchsorted(np.cumsum(sizes), begins, side="right")
        first = np.searchsorted(self.text, np.arange(len(texts)))
        self.place = np.arange(len(begins)) - first[self.text]
        named = languages.dictionary_encode()
        self.language = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        with np.errstate(over="ignore"):
            own = hashed(self.vocabulary)[self.codes]
            self.sums = np.r_[np.uint64(0), np.cumsum(own * _powers(BASE, len(own)), dtype=np.uint64)]
            self.salt = hashed(named.dictionary, 77)[self.language][self.text] if len(self.text) else np.zeros(0, np.uint64)

    def prints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all n-grams inside pieces, and their fingerprints, which also depend on language and length."""
        last = len(self.codes) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:last] == self.piece[n - 1:])
        with np.errstate(over="ignore"):
            found = (self.sums[at + n] - self.sums[at]) * _powers(INVERSE, last)[at]
            found = (found + (self.salt[at] | np.uint64(1)) * np.uint64(2 * n + 1)) * np.uint64(0xD6E8FEB86659FD93)
        return at, found ^ (found >> np.uint64(32))

    def different(self, at: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first place and number of each different n-gram."""
        order = np.argsort(prints, kind="stable")
        sorted_prints, spots = prints[order], at[order]
        new = np.r_[True, sorted_prints[1:] != sorted_prints[:-1]] if len(order) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        counts = np.diff(np.r_[begins, len(order)])
        heads = np.repeat(spots[begins], counts)
        odd = self.language[self.text[heads]] != self.language[self.text[spots]]
        for k in range(n):
            odd |= self.codes[heads + k] != self.codes[spots + k]
        if not odd.any():
            return sorted_prints[begins], spots[begins], counts
        counts -= np.add.reduceat(odd.astype(np.int64), begins)
        more = self.different(spots[odd], sorted_prints[odd], n)        # other phrases under the fingerprint of the first
        return tuple(np.concatenate(x) for x in zip((sorted_prints[begins], spots[begins], counts), more, strict=True))


def _rows(part: Slice, numbers: np.ndarray, sizes: tuple[int, ...], table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    allowed = None
    for n in sizes:
        at, prints = part.prints(n)
        if table is not None:
            if allowed is None:             # places at which a frequent pair may start
                pairs, found = part.prints(2)
                allowed = np.zeros(len(part.codes), dtype=bool)
                allowed[pairs[_in_filter(found, table)]] = True
            keep = np.ones(len(at), dtype=bool)
            for k in range(n - 1):
                keep &= allowed[at + k]
            at, prints = at[keep], prints[keep]
        prints, first, counts = part.different(at, prints, n)
        yield _batch(prints.view(np.int64), n, counts, numbers[part.text[first]], part.place[first])
    if table is None and len(part.codes):   # all words of a language, as phrases of no words
        per_text = np.bincount(part.text, minlength=len(part.language))
        names, first, of = np.unique(part.language, return_index=True, return_inverse=True)
        yield _batch(names, 0, np.bincount(of, weights=per_text).astype(np.int64), numbers[first], np.zeros(len(names), np.int64))


def _batch(prints, n, counts, row, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(prints, pa.int64()), pa.array(np.full(len(prints), n), pa.int8()), pa.array(counts, pa.int64()), pa.array(row, pa.int64()),
         pa.array(place, pa.int32())], names=["print", "size", "times", "row", "place"])


def _grams(texts: DataFrame, sizes: tuple[int, ...], table=None) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part = Slice(batch.column("text"), batch.column("lang"))
            yield from _rows(part, batch.column("row").to_numpy(), sizes, None if table is None else table.value)

    return texts.select("row", "lang", "text").mapInArrow(work, "print bigint, size tinyint, times bigint, row bigint, place int")


def _frequent(grams: DataFrame, least: int) -> DataFrame:
    total = F.sum("times").over(Window.partitionBy("print", "size"))
    return grams.withColumn("total", total).filter((F.col("total") >= least) | (F.col("size") == 0)).drop("total")


def _words_of(text: str) -> list[bytes]:
    data = bytearray(text.encode("utf-8"))
    return data.lower().translate(bytes(0x20 if k else b for b, k in enumerate(_KIND.tolist()))).split(b" ")


def _phrases(pointers: DataFrame, texts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``size`` and ``f``: the rows of frequent fingerprints written out and added up."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, phrases, sizes, times = [], [], [], []
            for lang, text, spots in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("spots"), strict=True):
                words = [w for w in _words_of(text) if w]
                rows = spots.values
                at, n = rows.field("place").to_pylist(), rows.field("size").to_pylist()
                phrases += [b" ".join(words[i:i + k]) for i, k in zip(at, n)]
                langs += [lang] * len(at)
                sizes += n
                times += rows.field("times").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int8()),
                                              pa.array(times, pa.int64())], names=["lang", "phrase", "size", "times"])

    spots = pointers.groupBy("row").agg(F.collect_list(F.struct("place", "size", "times")).alias("spots"))
    return texts.join(spots, "row").select("lang", "text", "spots") \
        .mapInArrow(work, "lang string, phrase string, size tinyint, times bigint") \
        .groupBy("lang", "phrase", "size").agg(F.sum("times").alias("f"))


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``phrase``, ``size`` and ``f`` of every phrase of 1 to ``longest`` words with ``least`` or more occurrences
    within pieces, staged; the phrase of no words has the number of all words of its language."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                              text.alias("text")).filter("text <> ''"), "texts")
    found = stage(_frequent(_grams(texts, tuple(range(min(2, longest) + 1))[1:]), least), "short_grams")
    if longest > 2:
        pairs = found.filter("size = 2").select(F.col("print").alias("anchor")).distinct()
        table = docs.sparkSession.sparkContext.broadcast(_filter_of(pairs, pairs.count()))
        found = found.union(stage(_frequent(_grams(texts, tuple(range(3, longest + 1)), table), least), "long_grams"))
    return stage(_phrases(found, texts).filter((F.col("f") >= least) | (F.col("size") == 0) & (F.col("f") > 0)), "phrases")


def _part(words: str, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (phrases of two words or more) with ``a``, the ``l``, ``r`` and ``score`` of their lowest cut; those within a
    longer candidate that is nearly as frequent are left out."""
    known = phrases.filter("size > 0").select("lang", "phrase", "f")
    longer = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = longer.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("k")) \
        .select("lang", "phrase", "a", "k", _part("words", F.lit(1), F.col("k")).alias("first"),
                _part("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]) \
        .join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + r)")
    lowest = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a") \
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = longer.filter("size > 2").select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.col("size").cast("int") - 1)).alias("n")) \
        .select("lang", "a", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("i")) \
        .select("lang", "a", _part("words", F.col("i"), F.col("n")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    hidden = F.col("around").isNotNull() & (100 * F.col("around").cast("decimal(20,0)") >= COVERED * F.col("a").cast("decimal(20,0)"))
    return lowest.join(inner, ["lang", "phrase"], "left").filter(~hidden).drop("around")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """The best ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    A-Z is lower-cased; words are split at blanks and tabs and stay within pieces between ``.,;:!?`` and line ends. A null
    language is ``und``; null texts count as empty; repeated rows and rows with null ids count like any other; equal scores and
    numbers are ordered by phrase (UTF-8 bytes); an empty table gives an empty result; other columns are not read. A long text
    is handled whole, in numpy arrays of a few times its size.
    """
    phrases = frequencies(docs, least, longest, text_col, lang_col)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored(phrases).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    words = phrases.filter("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
