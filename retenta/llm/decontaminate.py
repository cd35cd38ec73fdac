"""Benchmark decontamination by spaced seeds, in native expressions only.

A mask names the word positions that are hashed and ignores those between, so that a substituted word spoils only the
seeds that look at it. Seeds of test items and of documents are joined; around each hit the two texts are laid side by side
and compared word by word, and a stretch counts if few of its words differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from retenta.llm.seeds import all_seeds, bloom_filter, found_seeds, with_word_hashes
from retenta.session import stage

#: Word offsets that are hashed. Wherever two words of a window of 13 are changed, one of the first two masks fits somewhere
#: between them. Items of 3 to 12 words take the short ones: two changes in ten to twelve words and one in five to nine leave
#: three words in a row or (the middle one of five) two, a gap and one.
MASKS, SHORT = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8)), ((0, 1, 2), (0, 1, 3))
WINDOW, SAME = 13, 0.8


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, same: float = SAME) -> DataFrame:
    """One row per document and test item found in it: ``doc_id``, ``item_id``, ``start`` (word of the document where the
    item lies, counted from 0, negative if its beginning is cut off), ``n_same`` and ``n_words`` of the best window.

    A window is as many words as ``window`` says, or the whole item if that is shorter. An item is found if in one window
    at least the share ``same`` of the words agree place by place. Null texts count as empty; rows with a null id
    are left out; repeated rows of one id are one document; items of fewer than three words are not searched for; empty tables
    give no rows. Of several places the best counts, then the first. The masks find whatever passes at the standard
    ``window`` and ``same``; with a wider window or a lower share some patterns of more changes have no seed.
    """
    hashed_items = with_word_hashes(items, item_text_col, F.col(f"`{item_col}`").alias("item_id")).filter("item_id is not null")
    reach = window - 1
    sized = hashed_items.withColumn("size", F.size("hs"))
    seeds = stage(all_seeds(sized.filter(F.col("size") >= WINDOW), MASKS, reach, "item_id", "size")
                  .union(all_seeds(sized.filter(F.col("size") < WINDOW), SHORT, reach, "item_id", "size", first=len(MASKS)))
                  .withColumnsRenamed({"at": "item_at", "begin": "item_begin", "around": "item"}), "seeds")
    table, bits = bloom_filter(seeds)
    long, short = seeds.agg(F.bool_or(F.col("size") >= WINDOW), F.bool_or(F.col("size") < WINDOW)).first()
    masks, first = (MASKS if long or not short else ()) + (SHORT if short else ()), 0 if long or not short else len(MASKS)
    hashed = with_word_hashes(docs, text_col, F.col(f"`{id_col}`").cast("bigint").alias("doc_id")).filter("doc_id is not null")
    hits = found_seeds(hashed, masks, table, bits, reach, "doc_id", first=first).join(seeds, "seed") \
        .withColumn("start", F.col("at") - F.col("item_at"))
    first = F.greatest("begin", F.col("item_begin") + F.col("start"))
    last = F.least(F.col("begin") + F.size("around"), F.col("item_begin") + F.col("start") + F.size("item"))
    side = hits.select("doc_id", "item_id", "start", F.least(F.lit(window), "size").alias("n_words"),
                       F.slice("around", first - F.col("begin") + 1, last - first).alias("there"),
                       F.slice("item", first - F.col("start") - F.col("item_begin") + 1, last - first).alias("want"))
    equal = side.select("doc_id", "item_id", "start", "n_words", F.zip_with("there", "want", lambda a, b: (a == b).cast("int")).alias("equal"))
    places = F.when(F.size("equal") >= F.col("n_words"), F.sequence(F.lit(1), F.size("equal") - F.col("n_words") + 1)) \
        .otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.transform(places, lambda i: F.aggregate(F.slice("equal", i, F.col("n_words")), F.lit(0), lambda s, x: s + x)))
    scored = equal.withColumn("n_same", best).filter(F.col("n_same") >= F.lit(same) * F.col("n_words"))
    top = F.max(F.struct("n_same", (-F.col("start")).alias("first"), "n_words"))
    return scored.groupBy("doc_id", "item_id").agg(top.alias("top")).select(
        "doc_id", "item_id", (-F.col("top.first")).alias("start"), F.col("top.n_same").alias("n_same"),
        F.col("top.n_words").alias("n_words"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which a test item is found; columns stay, and rows with a null id are kept."""
    found = stage(leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "leaking")
    return docs.join(found, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
