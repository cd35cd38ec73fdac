"""SimHash near copies: fingerprints, pigeonhole blocks, and a check of the differing bits.

A fingerprint has 64 bits. It is split into six blocks; two fingerprints that differ in at most three bits agree in three
blocks or more, so they meet under at least one of the twenty choices of three blocks (31 bits or more, which chance rarely
gives). Under each choice the fingerprints of one bucket are compared. A bucket with very many different fingerprints is
split again in the same way over the bits that are still free, until it is small; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from retenta.llm.arrow import keyed_texts, slices
from retenta.llm.components import components
from retenta.session import stage

BLOCKS, BITS = 6, 3
#: Different fingerprints that one task compares directly; larger buckets are split again.
BUCKET = 4096


def fingerprint(words: list[bytes], size: int) -> int:
    """Bit b is 1 if it is set in over half of the hashes of the runs of ``size`` words, repeats included."""
    import xxhash
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 14):
        hashes = np.fromiter((digest(b" ".join(words[i:i + size]), 42) for i in range(lo, min(n, lo + (1 << 14)))), dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (the 64 bits as a bigint) of each row.

    A-Z is lower-cased and words are split at ASCII white space; a text of fewer than ``size`` words is one run, and one
    without words has fingerprint 0. Null texts count as empty; repeated rows and null ids stay; other columns are not
    read. A long text is hashed piece by piece.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t.lower().split(), size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            bits = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bits], names=["doc_id", "fingerprint"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, fingerprint bigint")


def _split(bits: list[int]) -> list[int]:
    """Masks of every choice of half the blocks into which the given bit positions are split."""
    blocks = [list(b) for b in np.array_split(bits, BLOCKS)]
    return [sum(1 << int(p) for b in chosen for p in b) for chosen in combinations(blocks, BLOCKS - BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(level: int) -> dict[int, list[int]]:
    """Masks of the next level by mask of this one; level 0 has the empty mask."""
    out = {0: _split(list(range(64)))}
    for _ in range(level):
        out = {m: [m | s for s in _split([b for b in range(64) if not m >> b & 1])] for ms in out.values() for m in ms}
    return out


def _forest(prints: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints that differ in few bits."""
    group, out = np.arange(len(prints)), []
    for i in range(len(prints) - 1):
        near = np.flatnonzero((np.bitwise_count(prints[i + 1:] ^ prints[i]) <= BITS) & (group[i + 1:] != group[i])) + i + 1
        if len(near):
            others, at = np.unique(group[near], return_index=True)
            out += [(int(nodes[i]), int(nodes[j])) for j in near[at]]
            group[np.isin(group, others)] = group[i]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets, which come as runs of rows with one mask and value; a run may cross batches."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
        cuts, out = np.r_[np.flatnonzero(new), len(rows)], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 1:
                out += _forest(rows[lo:hi, 2].view(np.uint64), rows[lo:hi, 3])
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.ascontiguousarray(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        rows = np.concatenate([*held, rows])
        same = (rows[:, :2] == rows[-1, :2]).all(1)
        last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0     # where the open run begins
        if last:
            yield links(np.ascontiguousarray(rows[:last]))
        held = [rows[last:]]
    if held:
        yield links(np.ascontiguousarray(held[0]))


def close_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` among rows of ``node``, ``fingerprint`` (each fingerprint once) that connect whatever is
    connected by pairs of at most three differing bits. Close pairs within a bucket are given as a spanning forest, not
    pair by pair."""
    out, rest = [], prints.select("node", "fingerprint", F.lit(0).cast("bigint").alias("mask"))
    for level in range(3):                  # 31, 47 and 55 bits or more are fixed: the last buckets hold 512 at most
        options = [(_signed(m), [_signed(x) for x in ms]) for m, ms in _masks(level).items()]
        if level:
            spark = prints.sparkSession
            table = spark.createDataFrame(options, "mask bigint, next array<bigint>")
            rows = rest.join(table, "mask").select("node", "fingerprint", F.explode("next").alias("mask"))
        else:
            rows = rest.select("node", "fingerprint", F.explode(F.array(*[F.lit(x) for x in options[0][1]])).alias("mask"))
        rows = rows.withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("size")).filter("size > 1")
        rows = stage(rows.join(sizes, ["mask", "value"]).select("mask", "value", "fingerprint", "node", "size"), "buckets")
        fits = F.lit(True) if level == 2 else F.col("size") <= bucket
        out.append(rows.filter(fits).select("mask", "value", "fingerprint", "node")
                   .repartition("mask", "value").sortWithinPartitions("mask", "value", "node")
                   .mapInArrow(_compare, "a bigint, b bigint"))
        rest = rows.filter(~fits).select("node", "fingerprint", "mask")
        if rest.isEmpty():
            break
    links = out[0]
    for more in out[1:]:
        links = links.union(more)
    return links


def near_copies(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of each row.

    The component is the smallest id reachable over links of at most three differing bits, the row's own included. Equal
    fingerprints are one node, named by their smallest id, so copies are never paired with each other. Rows with a null id
    keep it, link nothing, and get the component of their fingerprint if other rows have one, else null.
    """
    prints = stage(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = stage(prints.filter("doc_id is not null").groupBy("fingerprint").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    found = components(close_links(nodes.select("node", "fingerprint")))
    named = nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
