"""Toxicity: a factorization machine over hashed terms.

Besides a weight per term it learns a short vector per term; the product of two vectors is the weight of the pair, so
that an insult next to the mention of a group can count for more than both do alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from retenta.llm.arrow import hashed, keyed_texts, slices, split_words

BUCKETS = 1 << 16
MARKS = ".,;:!?\"'()[]{}<>*&%$#|-_=+/\\"


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray         # one per bucket
    factors: np.ndarray         # buckets by size of a vector

    def scores(self, starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Probability of each text, given its different terms as buckets in one run per text."""
        n = len(starts) - 1
        text = np.repeat(np.arange(n), np.diff(starts))
        raw = self.bias + np.bincount(text, self.weights[terms], n)
        for column in self.factors.T:
            v = column[terms]
            raw += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the documents that is never learned from; also where the id is null."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different terms of each text as buckets of their hash: words in lower case without outer marks, and the first
    four letters of longer ones, by which forms of one word are alike."""
    starts, codes, vocabulary = split_words(texts)
    names = pc.utf8_trim(pc.utf8_lower(vocabulary.cast(pa.string())), characters=MARKS)
    stems = pc.utf8_slice_codeunits(names, 0, 4).dictionary_encode()
    longer = pc.greater(pc.utf8_length(names), 4).to_numpy(zero_copy_only=False)
    word = (hashed(names) % np.uint64(BUCKETS)).astype(np.int64)
    stem = (hashed(stems.dictionary, 43) % np.uint64(BUCKETS)).astype(np.int64)[stems.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * BUCKETS
    pairs = np.unique(np.concatenate([text + word[codes], (text + stem[codes])[longer[codes]]]))
    return np.searchsorted(pairs, np.arange(len(starts)) * BUCKETS), pairs % BUCKETS


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = 8_000, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic") -> list[tuple[list[int], int]]:
    """Terms and label of at most ``limit`` labelled documents outside the held-out fifth, in the order of a hash.

    Of repeated labels of one document the largest counts; rows without id or label are left out. A row holds at most
    as many numbers as there are buckets, whatever the length of the text.
    """
    chosen = (labels.filter(~held_out(id_col))
              .select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
              .dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, terms = _terms(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(terms, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, batch.column("label")], names=["doc_id", "terms", "label"])

    rows = keyed_texts(docs, id_col, text_col).join(chosen, "doc_id").select("doc_id", "text", "label") \
        .mapInArrow(work, "doc_id bigint, terms array<int>, label int").collect()
    return [(r.terms, r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.terms))]


def fit(rows: list[tuple[list[int], int]], size: int = 8, rounds: int = 12, rate: float = 0.3, decay: float = 1e-3,
        least_texts: int = 4, least_z: float = 3.0, seed: int = 7) -> Machine:
    """Logistic loss, adaptive steps per parameter, one text at a time.

    Terms of fewer than ``least_texts`` texts stay 0, and so do those whose share of toxic texts is less than ``least_z``
    standard errors from the share of all: a long text has thousands of such terms, and their noise would add up.
    """
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(BUCKETS), np.zeros((BUCKETS, size))
    if not rows:
        return Machine(0.0, weights, factors)
    texts = [np.asarray(t, dtype=np.int64) for t, _ in rows]
    labels = np.array([y for _, y in rows])
    share = (labels.sum() + 1) / (len(labels) + 2)
    sizes = [len(t) for t in texts]
    n = np.bincount(np.concatenate(texts), minlength=BUCKETS)
    toxic = np.bincount(np.concatenate(texts), np.repeat(labels, sizes), BUCKETS)
    z = (toxic - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    seen = (n >= least_texts) & (np.abs(z) >= least_z)
    factors[seen] = rng.normal(0, 0.01, (int(seen.sum()), size))
    texts = [t[seen[t]] for t in texts]
    bias, bias_sq = float(np.log(share / (1 - share))), 1e-8
    weight_sq, factor_sq = np.full(BUCKETS, 1e-6), np.full((BUCKETS, size), 1e-6)
    for _ in range(rounds):
        for i in rng.permutation(len(texts)):
            t = texts[i]
            v = factors[t]
            total = v.sum(0)
            raw = bias + weights[t].sum() + 0.5 * float((total * total - (v * v).sum(0)).sum())
            off = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i]
            bias_sq += off * off
            bias -= 0.1 * rate * off / np.sqrt(bias_sq)
            g = off + decay * weights[t]
            weight_sq[t] += g * g
            weights[t] -= rate * g / np.sqrt(weight_sq[t])
            gv = off * (total - v) + decay * v
            factor_sq[t] += gv * gv
            factors[t] -= 0.1 * rate * gv / np.sqrt(factor_sq[t])
    return Machine(bias, weights, factors)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, the probability that a text is toxic, from its words alone.

    Null and empty texts get the score of no terms; repeated rows and null ids stay; other columns are not read; an
    empty table gives an empty result. Whole texts count, however long.
    """
    used = (machine.weights != 0) | (machine.factors != 0).any(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, terms = _terms(batch.column("text"))
            keep = used[terms]
            found = machine.scores(np.r_[0, np.cumsum(keep)][starts], terms[keep])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, score double")
