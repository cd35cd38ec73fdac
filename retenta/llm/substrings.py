"""Removal of passages that repeat across documents, by compressed full-text indexes over shards.

1. Every window of words has an anchor: the smallest hash of the short runs of words in it. Equal windows have equal anchors.
   Anchors are counted over the corpus; those of one document only are set aside.
2. Neighbouring windows with one anchor form a segment. Segments whose anchor occurs in several documents are kept, with the
   smallest and largest document of each different segment, and sent to the shard of their anchor: equal windows meet there.
3. Each shard indexes its segments and searches every window of them backward. The rows found name all segments with that
   window, and so the first document that has it.
4. Windows that start in an earlier document are taken out of the later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from retenta.llm.arrow import hashed, slices, split_words
from retenta.llm.fm_index import WordIndex
from retenta.session import stage

WINDOW, RUN = 13, 6
#: Bound of the filter of repeated anchors. Past it more segments pass, which costs work and changes nothing.
FILTER_BITS = 1 << 27
#: Repeated anchors per shard, and places of one anchor beyond which its windows are sent out one by one.
SHARD, COMMON = 30_000, 200_000
#: Anchors are counted by so many of their bits; two that agree in them only let more segments pass.
COUNTED = (1 << 48) - 1


def _segments(batch: pa.RecordBatch, window: int, run: int):
    """Words of a batch and its segments: anchor (its counted bits), text, first window (place among all words) and number of
    windows."""
    words = split_words(batch.column("text"))
    starts, codes = words.starts, words.codes
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < window:
        return words, none.astype(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        one = hashed(words.vocabulary)[codes]
        runs = np.zeros(len(codes) - run + 1, dtype=np.uint64)
        for k in range(run):
            runs = (runs ^ one[k:len(codes) - run + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(31)
    size, low = 1, runs
    while size < window - run + 1:                  # smallest of ever longer stretches, each of two shorter ones
        step = min(size, window - run + 1 - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(text[:len(low)] == text[window - 1:])
    new = np.r_[True, (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (text[at[1:]] != text[at[:-1]])] if len(at) else none.astype(bool)
    begin = np.flatnonzero(new)
    return words, low[at[begin]] & np.uint64(COUNTED), text[at[begin]], at[begin], np.diff(np.r_[begin, len(at)])


def _repeated(batch: pa.RecordBatch, window: int, run: int, table: np.ndarray, busy: np.ndarray) -> pa.Table:
    """Segments of a batch whose anchor passes the filter: ``doc``, ``copy``, ``start``, ``anchor`` and ``segment`` (its words).

    Segments of a busy anchor are given as their single windows, each with a hash of its own words for an anchor.
    """
    words, anchors, text, at, n = _segments(batch, window, run)
    keep = _in_filter(anchors, table)
    anchors, text, at, n = anchors[keep], text[keep], at[keep], n[keep]
    many = np.isin(anchors, busy)
    if many.any():
        single = np.repeat(at[many], n[many]) + np.arange(n[many].sum()) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
        one = hashed(words.vocabulary, 43)
        with np.errstate(over="ignore"):
            own = np.zeros(len(single), dtype=np.uint64)
            for k in range(window):
                own = (own ^ one[words.codes[single + k]]) * np.uint64(0x9E3779B97F4A7C15)
                own ^= own >> np.uint64(31)
        text = np.r_[text[~many], np.repeat(text[many], n[many])]
        anchors, at, n = np.r_[anchors[~many], own], np.r_[at[~many], single], np.r_[n[~many], np.ones(len(single), dtype=np.int64)]
    sizes = n + window - 1
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), words.vocabulary.take(pa.array(words.codes[places])))
    return pa.table({"doc": batch.column("doc").take(pa.array(text)), "copy": batch.column("copy").take(pa.array(text)),
                     "start": pa.array(at - words.starts[text], pa.int32()), "anchor": pa.array(anchors.view(np.int64)),
                     "segment": pc.binary_join(lists, " ")})


def _filter_of(anchors: DataFrame, n: int) -> np.ndarray:
    """Two bits for each of ``n`` anchors in a bit table whose size follows their number up to a bound."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * max(1, n) - 1).bit_length()))
    number = F.explode(F.array(*[F.shiftrightunsigned("anchor", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 20)]))
    found = anchors.select(number.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _in_filter(anchors: np.ndarray, table: np.ndarray) -> np.ndarray:
    hit = np.ones(len(anchors), dtype=bool)
    for shift in (0, 20):
        bit = (anchors >> np.uint64(shift)) & np.uint64(64 * len(table) - 1)
        hit &= (table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def _first_documents(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For each segment of a shard the first document of each of its windows, through the shard's index."""
    full = [b for b in batches if b.num_rows]
    if not full:
        return
    table = pa.Table.from_batches(full).group_by("segment").aggregate([("doc", "min"), ("last", "max")]) \
        .rename_columns({"doc_min": "doc", "last_max": "last"}).combine_chunks()
    words = split_words(pa.concat_arrays(table.column("segment").chunks))
    n = len(words.starts) - 1
    sizes = np.diff(words.starts)
    text = np.zeros(len(words.codes) + n, dtype=np.int64)           # a 0 behind every segment
    piece = np.repeat(np.arange(n), sizes)
    text[np.arange(len(words.codes)) + piece] = words.codes + 1
    index = WordIndex(text, window)
    owner = np.repeat(np.arange(n), sizes + 1)
    inside = np.arange(len(words.codes)) - words.starts[piece] <= sizes[piece] - window
    starts = (np.arange(len(words.codes)) + piece)[inside]
    low, high = index.search(text, starts, window)
    docs = table.column("doc").to_numpy()
    by_row = docs[owner[index.order]]
    first = docs[owner[starts]].copy()
    many = np.flatnonzero(high - low > 1)
    if len(many):
        rows, where = np.unique(low[many], return_index=True)        # equal windows have equal rows: each is summed up once
        ends = high[many][where]
        edges = np.column_stack([rows, ends]).ravel()
        least = np.minimum.reduceat(np.r_[by_row, np.iinfo(np.int64).max], edges)[::2]
        first[many] = least[np.searchsorted(rows, low[many])]
    counts = np.bincount(owner[starts], minlength=n)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(first, pa.int64()))
    keep = table.column("last").to_numpy() > np.minimum.reduceat(np.r_[first, np.iinfo(np.int64).max], np.r_[0, np.cumsum(counts)][:-1])
    out = pa.Table.from_arrays([table.column("segment"), lists], names=["segment", "first"]).filter(pa.array(keep))
    yield from out.to_batches(max_chunksize=20_000)


def repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, shard: int = SHARD, common: int = COMMON) -> DataFrame:
    """``doc``, ``copy`` (hash of its text) and ``starts``: every window of it that also starts in a smaller ``doc``.

    ``docs`` has ``doc`` (not null), ``copy`` and ``text``.
    """
    spark = docs.sparkSession

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, anchors, text, _, _ = _segments(batch, window, run)
            ids = batch.column("doc").to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(ids)], names=["anchor", "doc"])

    counted = docs.select("doc", "copy", "text").mapInArrow(anchors_of, "anchor bigint, doc bigint").groupBy("anchor") \
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).filter("least < most")
    anchors = stage(counted.select("anchor", "n"), "anchors")
    n = anchors.count()
    busy = anchors.filter(F.col("n") > common).select("anchor").toArrow().column(0).to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((_filter_of(anchors, n), busy))

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from _repeated(batch, window, run, *shared.value).to_batches()

    def different_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each segment once per slice of texts, so that a passage of very many documents is sent on few times."""
        for batch in slices(batches):
            found = _repeated(batch, window, run, *shared.value).group_by(["anchor", "segment"]) \
                .aggregate([("doc", "min"), ("doc", "max")]).rename_columns({"doc_min": "doc", "doc_max": "last"})
            yield from found.select(["anchor", "segment", "doc", "last"]).to_batches()

    first = docs.mapInArrow(different_of, "anchor bigint, segment string, doc bigint, last bigint") \
        .repartition(max(1, -(-n // shard)), "anchor").select("segment", "doc", "last") \
        .mapInArrow(lambda batches: _first_documents(batches, window), "segment string, first array<bigint>")
    found = docs.mapInArrow(places_of, "doc bigint, copy bigint, start int, anchor bigint, segment string")

    def key(name: str) -> list:
        return [F.xxhash64(name).alias("k1"), F.xxhash64(F.lit(1), name).alias("k2")]

    later = found.select("doc", "copy", "start", *key("segment")).join(first.select(*key("segment"), "first"), ["k1", "k2"])
    places = F.filter(F.transform("first", lambda f, j: F.when(f < F.col("doc"), F.col("start") + j)), lambda x: x.isNotNull())
    return later.select("doc", "copy", places.alias("starts")).filter(F.size("starts") > 0) \
        .groupBy("doc", "copy").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **tuning) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``removed`` (stretches of words, end exclusive) and ``kept`` (the other words,
    joined by one space) of each row.

    Null texts count as empty. A row with a null id is neither an earlier document nor has words removed. Rows of one id are
    one document: none is earlier than another. Other columns are not read; an empty table gives an empty result. Texts are
    whole, and a long one is cut nowhere.
    """
    keyed = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")) \
        .select("doc", F.xxhash64("text").alias("copy"), "text")
    starts = repeats(keyed.filter("doc is not null"), window, **tuning)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, spans, kept = [], [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("starts"), strict=True):
                words = text.encode("utf-8").split()
                n_words.append(len(words))
                if not at.is_valid:
                    n_removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                change = np.zeros(len(words) + 1, dtype=np.int32)
                begin = np.unique(at.values.to_numpy())
                np.add.at(change, begin, 1)
                np.add.at(change, begin + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                n_removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return keyed.join(starts, ["doc", "copy"], "left").select("doc", "text", "starts").mapInArrow(
        work, "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string")
