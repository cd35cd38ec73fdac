"""URL filters: rules by host and path, and the ratio of two character models.

Where no rule decides, a URL is scored by two variable-order Markov models of characters, one of accepted and one of
rejected URLs. The models are smoothed by interpolation: each order hands the weight of unseen characters to the next lower.
The difference of the log-likelihoods, divided by the length, is compared with a threshold calibrated on URLs that were not
counted.

The counts are a Spark table with one row per context and per context with character, so they grow with the URLs. To score,
URLs are put into blocks; each block asks once for every context and character it holds, a join answers, and answers and URLs of
a block meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from retenta.session import stage

#: Longest context in characters, and characters of the URLs of one block.
ORDER, BLOCK = 4, 1 << 19
#: One of so many decided URLs is kept for calibration and not counted.
HELD_OUT = 5


@dataclass(frozen=True)
class Rule:
    verdict: str        # allow or block
    host: str
    path: str = "/"

    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``. Linear in the length of the URL."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def with_rule(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule`` (name of the longest fitting rule, else null) and ``decided`` (its
    verdict). A rule fits its host and all subdomains where the path starts with the rule's. Of equally long rules the
    first counts. Null URLs have empty parts; repeated rows and null ids stay; other columns are not read.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        host.alias("host"), path.alias("path"))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name())):        # longer rules are asked first, so they come last here
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, decided = F.when(fits, r.name()).otherwise(rule), F.when(fits, r.verdict).otherwise(decided)
    return rows.withColumn("rule", rule).withColumn("decided", decided)


def _codes(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All URLs as one array of code points with ``ORDER`` start marks before and an end mark behind each, and its ends."""
    parts = [np.frombuffer(("^" * ORDER + u.lower() + "$").encode("utf-32-le"), dtype=np.uint32) for u in urls]
    return np.concatenate(parts).astype(np.uint64), np.cumsum([len(p) for p in parts])


def _keys(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of context (order by place) and of context with character, and the URL of each place."""
    mix, places = np.uint64(0x9E3779B97F4A7C15), np.ones(len(codes), dtype=bool)
    starts = np.r_[0, ends[:-1]]
    for k in range(ORDER):
        places[starts + k] = False
    at = np.flatnonzero(places)
    contexts, grams = [], []
    context = np.zeros(len(at), dtype=np.uint64)
    for n in range(ORDER + 1):
        if n:
            context = (context + codes[at - n] + np.uint64(n)) * mix
            context ^= context >> np.uint64(29)
        gram = (context + codes[at] * np.uint64(0x632BE59BD9B4E019) + np.uint64(1)) * mix
        contexts.append((context + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93))
        grams.append(gram ^ (gram >> np.uint64(31)))
    return np.stack(contexts).view(np.int64), np.stack(grams).view(np.int64), np.searchsorted(ends, at, side="right")


def count(urls: DataFrame) -> DataFrame:
    """Both models from rows of ``url`` and ``accepted`` (0/1), counted over all of them: ``key``, ``rejected`` and ``accepted``
    (how often the context, or context with character, occurs in each class) and ``kinds0`` and ``kinds1`` (different
    characters behind a context). Tasks add up keys before anything is shuffled.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, ends = _codes(batch.column("url").to_pylist())
            contexts, grams, url = _keys(codes, ends)
            label = batch.column("accepted").to_numpy(zero_copy_only=False).astype(bool)[url]
            for context, gram in zip(contexts, grams, strict=True):
                keys, first, of = np.unique(gram, return_index=True, return_inverse=True)
                counts = np.bincount(of, ~label, len(keys)), np.bincount(of, label, len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(context[first]), pa.array(keys), *(pa.array(c.astype(np.int64)) for c in counts)],
                                                 names=["context", "gram", "rejected", "accepted"])

    sums = [F.sum(c).alias(c) for c in ("rejected", "accepted")]
    grams = stage(urls.select("url", "accepted").mapInArrow(work, "context bigint, gram bigint, rejected bigint, accepted bigint")
                  .groupBy("context", "gram").agg(*sums), "grams")
    contexts = grams.groupBy("context").agg(*sums, F.count_if(F.col("rejected") > 0).alias("kinds0"), F.count_if(F.col("accepted") > 0).alias("kinds1"))
    none = F.lit(0).cast("bigint")
    return stage(grams.select(F.col("gram").alias("key"), "rejected", "accepted", none.alias("kinds0"), none.alias("kinds1"))
                 .union(contexts.select(F.col("context").alias("key"), "rejected", "accepted", "kinds0", "kinds1")), "models")


def _log_likelihood(seen: np.ndarray, after: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Log probability of each character, interpolated from no context to the longest (Witten-Bell weights). By order: how often
    the context, and the context with the character, was seen, and different characters behind it."""
    p = np.full(seen.shape[1], 1 / 256)
    for total, c, k in zip(seen, after, kinds, strict=True):
        p = np.where(total > 0, (c + k * p) / np.maximum(total + k, 1), p)
    return np.log(p)


def score(pages: DataFrame, models: DataFrame, url_col: str = "url", block: int = BLOCK) -> DataFrame:
    """Adds ``ratio``: log-likelihood of the accepted model less that of the rejected one, per character. Null URLs count as
    empty text."""
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(url_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ORDER + 1
            ends = used + np.cumsum(sizes)
            used = int(ends[-1]) if len(ends) else used
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + ends // block)], names=[*batch.schema.names, "block"])

    rows = stage(pages.mapInArrow(numbered, pages.withColumn("block", F.lit(0).cast("bigint")).schema), "url_blocks")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for b in np.unique(blocks):
                part = batch.filter(pa.array(blocks == b))
                contexts, grams, _ = _keys(*_codes(part.column(url_col).fill_null("").to_pylist()))
                keys = np.unique(np.concatenate([contexts.ravel(), grams.ravel()]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b)), pa.array(keys)], names=["block", "key"])

    answers = rows.select("block", url_col).mapInArrow(asked, "block bigint, key bigint").join(models, "key")

    def scored(urls: pa.Table, known: pa.Table) -> pa.Table:
        if not urls.num_rows:
            return urls.drop_columns(["block"]).append_column("ratio", pa.array([], pa.float64()))
        contexts, grams, url = _keys(*_codes(urls.column(url_col).combine_chunks().fill_null("").to_pylist()))
        keys, first = np.unique(known.column("key").to_numpy(), return_index=True)
        keys = np.r_[keys, np.iinfo(np.int64).max]

        def values(name: str, wanted: np.ndarray) -> np.ndarray:
            column = np.r_[known.column(name).to_numpy()[first], 0]
            at = np.searchsorted(keys, wanted)
            return np.where(keys[at] == wanted, column[at], 0)

        gap = _log_likelihood(values("accepted", contexts), values("accepted", grams), values("kinds1", contexts)) \
            - _log_likelihood(values("rejected", contexts), values("rejected", grams), values("kinds0", contexts))
        ratio = np.bincount(url, gap, urls.num_rows) / np.bincount(url, minlength=urls.num_rows)
        return urls.drop_columns(["block"]).append_column("ratio", pa.array(ratio))

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, pages.withColumn("ratio", F.lit(0.0)).schema)


def threshold(scored: DataFrame, low: float = -4.0, high: float = 4.0, bins: int = 800) -> float:
    """The ratio from which the mean of the two classes' shares of right answers is largest, over the decided URLs among ``scored``.

    Ratios are counted in a fixed number of bins. With one class alone, everything goes to it.
    """
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("ratio") - low) * bins / (high - low)))).cast("int")
    rows = scored.filter("decided is not null").groupBy(place.alias("bin"), (F.col("decided") == "allow").alias("good")) \
        .agg(F.count("*").alias("c")).collect()
    good, bad = np.zeros(bins), np.zeros(bins)
    for r in rows:
        (good if r.good else bad)[r.bin] = r.c
    if not good.sum() or not bad.sum():
        return -np.inf if good.sum() or not bad.sum() else np.inf
    right = np.r_[good[::-1].cumsum()[::-1], 0] / good.sum() + np.r_[0, bad.cumsum()] / bad.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return low + (high - low) * float(best[len(best) // 2]) / bins


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``ratio`` and ``verdict`` (allow or block) of each row.

    The models are counted over four fifths of the URLs that a rule decides, told by a hash of the URL, repeats included; the
    threshold is set on the last fifth. The rule's verdict stands, the others get the models'. Null URLs are scored as empty text;
    null ids and repeated rows stay; other columns are not read. An empty table gives an empty result; without any URL to
    calibrate on all are allowed, and with one class alone all go to it.
    """
    held = F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(HELD_OUT)) == 0
    rows = with_rule(pages, rules, id_col, url_col)
    decided = rows.filter(F.col("decided").isNotNull() & F.col("url").isNotNull() & ~held).select(
        "url", (F.col("decided") == "allow").cast("int").alias("accepted"))
    scored = stage(score(rows, count(decided)), "scored_urls")
    limit = threshold(scored.filter(held))
    verdict = F.coalesce("decided", F.when(F.col("ratio") >= F.lit(limit), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", "ratio", verdict.alias("verdict"))
