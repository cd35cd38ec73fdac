"""Chunking of documents and retrieval of passages by vector similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from retenta import schema
from retenta.functions import text
from retenta.operators.ordering import top_k
from retenta.session import stage

QUERY_BLOCK = 512
#: Chunks that are compared with a block of search texts at once.
PACK = 4096


# --------------------------------------------------------------- chunks
def chunk_documents(docs: DataFrame, source: str, body: str, size: int = 300, overlap: int = 50,
                    longer_than: int = 30) -> DataFrame:
    """``(id, source, chunk_idx, total_chunks, content)``: numbering follows the removal of short windows."""
    pieces = text.chunks(F.col(body), size, overlap, longer_than)
    cut = docs.select(F.col(source).cast("string").alias("source"), pieces.alias("__p"))
    rows = cut.select("source", F.size("__p").alias("total_chunks"), F.posexplode("__p").alias("chunk_idx", "content"))
    digest = F.substring(F.sha2(F.concat_ws("\n", "source", F.col("chunk_idx").cast("string"), "content"), 256), 1, 8)
    ident = F.concat_ws("_", "source", F.col("chunk_idx").cast("string"), digest)
    return rows.select(ident.alias("id"), "source", "chunk_idx", "total_chunks", "content")


# --------------------------------------------------------------- passages by shared terms
def terms(body: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _damped(times: Column) -> Column:
    return 1 + F.log(times.cast("double"))


def term_counts(df: DataFrame, key: str, body: str) -> DataFrame:
    """``(key, term, weight)``, one row per text and different term; a term found n times weighs ``1 + ln n``."""
    split = df.select(key, F.explode(terms(F.col(body))).alias("term"))
    return split.groupBy(key, "term").agg(_damped(F.count("*")).alias("weight"))


def search(queries: DataFrame, chunks: DataFrame, query: str = "query", key: str = "chunk_id", body: str = "content",
           k: int = 2, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact ``k`` most similar chunks per search text: ``(query, key, similarity, rank)``.

    Cosine similarity of damped term counts, where terms of search texts also weigh ``ln((N + 1) / (df + 1))``. One pass counts
    in how many chunks each term stands, combined map-side. In the second, chunks are packed by ``PACK`` and every pack is joined
    with all blocks of about ``block`` search texts; a task sums the products of the terms that both have and keeps the ``k``
    best per search text, so no pair of search text and chunk is shuffled. A search text none of whose terms is found has no
    rows. Equal similarities (to nine decimals) are ordered by key; null texts have no terms, chunks with a null key are left out.
    """
    if query == key:
        raise ValueError("query and chunk keys need different names")
    asked = stage(term_counts(queries.select(query).distinct().withColumn("__body", F.col(query)), query, "__body"), "asked")
    frequency = (chunks.select(F.explode(F.array_distinct(terms(F.col(body)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
                 .join(asked.select("term").distinct(), "term", "left_semi"))
    n = chunks.agg(F.count("*")).scalar()
    rarity = F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1))
    weighed = asked.join(frequency, "term", "left").select(query, "term", (F.col("weight") * rarity).alias("q"))
    listed = stage(weighed.groupBy(F.col(query).alias("name")).agg(F.collect_list(F.struct("term", "q")).alias("x"), F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
                   .filter("length > 0"), "weighed")
    blocks = -(-listed.count() // block)
    out_schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(key, chunks.schema[key].dataType),
                               T.StructField("similarity", T.DoubleType())])
    if not blocks:
        return queries.sparkSession.createDataFrame([], out_schema.add("rank", "int"))
    packed = listed.groupBy(F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("name", "length", "x")).alias("r")).select(
        "block", F.col("r.name").alias("name"), F.col("r.length").alias("length"), F.transform("r", lambda r: r["x"]["term"]).alias("terms"),
        F.transform("r", lambda r: r["x"]["q"]).alias("q"))
    arrow_types = [to_arrow_type(f.dataType) for f in out_schema]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK):
                part = batch.slice(lo, PACK)
                rows = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([x])) for x in part.columns]
                yield pa.RecordBatch.from_arrays(rows, names=["k", "bodies"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, length, terms_, q, ids, words = (batch.column(c)[row].values for c in ("name", "length", "terms", "q", "k", "words"))
                hits = _by_terms(terms_, q, length.to_numpy(), words, np.array(ids.to_pylist()), k)
                names = name.to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(
                    ([names[j] for j, *_ in hits], [i for _, i, _ in hits], [s for *_, s in hits]), arrow_types)], names=out_schema.names)

    packs = chunks.select(F.col(key).alias("k"), F.col(body).alias("body")).dropna().mapInArrow(pack, T.StructType([
        T.StructField("k", T.ArrayType(out_schema[key].dataType)), T.StructField("bodies", T.ArrayType(T.StringType()))]))
    pairs = packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(packed, "block")
    found = pairs.select("name", "length", "terms", "q", "k", F.transform("bodies", terms).alias("words")).mapInArrow(best, out_schema)
    return top_k(found, k, [F.desc("similarity"), F.col(key)], [query])


def _by_terms(asked: pa.ListArray, weights: pa.ListArray, lengths: np.ndarray, words: pa.ListArray, ids: np.ndarray, k: int) -> list[tuple]:
    """``(number of the search text, id, similarity)`` of the ``k`` best of the texts ``words`` for each search text, whose terms and
    their weights are ``asked`` and ``weights``."""
    n, sizes = len(words), words.value_lengths().to_numpy()
    coded = words.flatten().dictionary_encode()
    d = max(1, len(coded.dictionary))
    cell, times = np.unique(np.repeat(np.arange(n), sizes) * d + coded.indices.to_numpy(), return_counts=True)
    text_, term, weight = cell // d, cell % d, 1 + np.log(times)
    weight = weight / np.sqrt(np.bincount(text_, weight * weight, n))[text_]
    wanted = asked.flatten().dictionary_encode()
    place = pc.index_in(coded.dictionary, value_set=wanted.dictionary).fill_null(-1).to_numpy()[term]
    order = np.argsort(place, kind="stable")[np.count_nonzero(place < 0):]
    text_, weight = text_[order], weight[order]
    starts = np.searchsorted(place[order], np.arange(len(wanted.dictionary) + 1))
    of, q, edges = wanted.indices.to_numpy(), weights.flatten().to_numpy(), np.r_[0, np.cumsum(asked.value_lengths().to_numpy())]
    out = []
    for j in range(len(asked)):
        cuts = [(starts[of[x]], starts[of[x] + 1], q[x]) for x in range(edges[j], edges[j + 1])]
        dots = np.bincount(np.concatenate([text_[lo:hi] for lo, hi, _ in cuts]), np.concatenate([weight[lo:hi] * x for lo, hi, x in cuts]), n)
        sims = np.round(dots / lengths[j], 9)
        some = np.flatnonzero(sims > 0)
        out += [(j, *x) for x in _best(sims[some], ids[some], k)]
    return out


# --------------------------------------------------------------- nearest vectors
def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key, summed map-side."""
    return (df.groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("__m"))
            .select(key, vector_to_array("__m").alias(vector)))


def nearest(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str, k: int = 2,
            vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """Exact ``k`` most cosine-similar corpus rows per query: ``(query_key, corpus_key, similarity, rank)``.

    Both sides are packed into blocks of about ``block`` rows. Every pack of the corpus names the numbers of all query blocks
    and is joined with them by number; a task multiplies the two blocks and keeps the ``k`` best per query, so what
    follows is ``k`` rows per query and pair of blocks, never query-by-corpus pairs. One plan, whatever the number of
    queries; only that number reaches the driver. Null vectors are left out.
    """
    if query_key == corpus_key:
        raise ValueError("query and corpus keys need different names")
    asked = queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    blocks = -(-asked.count() // block)
    out_schema = T.StructType([
        T.StructField(query_key, queries.schema[query_key].dataType),
        T.StructField(corpus_key, corpus.schema[corpus_key].dataType), T.StructField("similarity", T.DoubleType())])
    if not blocks:
        return queries.sparkSession.createDataFrame([], out_schema.add("rank", "int"))
    arrow_types = [to_arrow_type(f.dataType) for f in out_schema]
    packed = asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("q", "v")).alias("rows")).select("block", F.col("rows.q").alias("q"), F.flatten("rows.v").alias("qv"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                rows = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column("k"), part.column("v").flatten())]
                yield pa.RecordBatch.from_arrays(rows, names=["k", "kv"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, ids = (np.array(batch.column(c)[i].values.to_pylist()) for c in ("q", "k"))
                q, e = (_unit(batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(len(n), -1)) for c, n in (("qv", names), ("kv", ids)))
                # Rounding keeps equal vectors equal, whatever their place in a block.
                sims = np.round(e @ q.T, 12)
                rows = [(names[j].item(), *x) for j in range(len(names)) for x in _best(sims[:, j], ids, k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in enumerate(arrow_types)],
                                                 names=[query_key, corpus_key, "similarity"])

    found = corpus.select(F.col(corpus_key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    packs = found.mapInArrow(pack, T.StructType([T.StructField("k", T.ArrayType(out_schema[corpus_key].dataType)),
                                                 T.StructField("kv", T.ArrayType(T.DoubleType()))]))
    pairs = packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(packed, "block")
    return top_k(pairs.select("q", "qv", "k", "kv").mapInArrow(best, out_schema), k, [F.desc("similarity"), F.col(corpus_key)], [query_key])


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """The ``k`` highest similarities with their ids, lower ids first on ties."""
    if len(sims) > k:
        top = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k])
        sims, ids = sims[top], ids[top]
    order = np.lexsort((ids, -sims))[:k]
    return [(ids[i].item(), float(sims[i])) for i in order]


def _unit(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    m = np.array(vectors, dtype=float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


# --------------------------------------------------------------- context per subject
def driver_query(feature: Column) -> Column:
    return F.coalesce(text.literal_map(schema.DRIVER_QUERIES)[feature], F.replace(feature, F.lit("_"), F.lit(" ")))


def select_queries(drivers: Column) -> Column:
    """Search texts of the drivers that push towards leaving, in order."""
    return F.transform(F.filter(drivers, lambda d: d["shap"] > 0), lambda d: F.struct(
        d["feature"].alias("feature"), driver_query(d["feature"]).alias("query")))


def _list_parts(lists: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages of each list of drivers (``asked``), the first occurrence of a passage kept."""
    wanted = lists.select("asked", F.posexplode("asked").alias("driver_pos", "d")).select(
        "asked", "driver_pos", F.col("d.feature").alias("feature"), F.col("d.query").alias("query"))
    # Hits are few: a fixed number per search text. Staged, their size is known to the planner.
    passages = stage(hits.join(chunks.select(F.col("id").alias("chunk_id"), "source", "content"), "chunk_id"), "passages")
    found = wanted.join(passages, "query")
    # A list has a handful of drivers and each driver a fixed number of hits, so a group is small.
    first = found.groupBy("asked", "chunk_id").agg(F.min_by(
        F.struct("feature", "source", "content"), F.struct("driver_pos", "rank")).alias("p"),
        F.min(F.struct("driver_pos", "rank")).alias("position"))
    return first.select("asked", "position", F.col("p.feature").alias("feature"), "chunk_id",
                        F.col("p.source").alias("source"), F.col("p.content").alias("content"))


def _asked(drivers: str) -> Column:
    return select_queries(F.col(drivers)).alias("asked")


def context_parts(subjects: DataFrame, hits: DataFrame, chunks: DataFrame, key: str = "employee_id",
                  drivers: str = "top_shap_drivers") -> DataFrame:
    """Passages per subject, the first occurrence of a passage kept: ``(key, position, feature, chunk_id, source, content)``.

    ``hits`` holds ``(query, chunk_id, rank)`` for the distinct search texts. Passages depend on the list of drivers only: they are
    found once per different list and joined to the subjects, so that no passage is shuffled per subject.
    """
    people = subjects.select(key, _asked(drivers))
    parts = stage(_list_parts(people.select("asked").distinct(), hits, chunks), "list-parts")
    return people.join(parts, "asked").drop("asked")


def with_policy_context(subjects: DataFrame, hits: DataFrame, chunks: DataFrame, drivers: str = "top_shap_drivers",
                        name: str = "policy_context") -> DataFrame:
    """:func:`policy_context` of :func:`context_parts`: the text is made once per different list of drivers."""
    people = subjects.withColumn("__asked", _asked(drivers))
    lists = people.select(F.col("__asked").alias("asked")).distinct()
    texts = stage(policy_context(lists, _list_parts(lists, hits, chunks), "asked", name), "list-contexts")
    joined = people.join(texts.select(F.col("asked").alias("__asked"), name), "__asked", "left")
    return joined.select(*subjects.columns, F.coalesce(F.col(name), F.lit(schema.NO_CONTEXT)).alias(name))


def policy_context(subjects: DataFrame, parts: DataFrame, key: str = "employee_id", name: str = "policy_context") -> DataFrame:
    """Add the joined passages of each subject, or a fixed sentence when there are none."""
    line = F.concat(F.lit("[Policy: "), F.col("source"), F.lit(" | Relevant to: "), F.col("feature"), F.lit("]\n"),
                    F.col("content"))
    joined = parts.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]),
        "\n\n---\n\n").alias(name))
    return subjects.join(joined, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(schema.NO_CONTEXT)))
