"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Tokens of both kinds are laid over the bytes of a text; two tokens whose bytes overlap are linked. Texts are numbered in blocks
of at most 65,536. For every pair of ids and block, the texts that link the pair form a bitmap, kept as bit planes of the number
of links: plane k holds the texts whose number has bit k set. A plane is a sorted list of 16-bit places, or 8 KiB of bits where
that is shorter. Planes joined by OR and popcounted give the number of texts of a pair; planes popcounted and weighted by 2^k
give its links. Pairs with their counts then go back over the same planes, block by block, and add up each text's scores.

Tokens of both kinds end before a space that follows another character, and between a letter or digit and a stop that no piece
holds together. Texts are split there, and each different stretch is aligned once per worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

from retenta.llm.arrow import keyed_texts, slices
from retenta.llm.bpe import _ship
from retenta.llm.pieces import MARK, _stretched, encoder_of
from retenta.session import stage

#: Texts of a block at most (places have 16 bits), and postings after which a block is closed.
BLOCK, POSTINGS = 1 << 16, 3_000_000
DENSE = BLOCK // 16
#: Fixed value: the splitting pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STOPS = ".,;:!?"
#: Different stretches kept per worker (the table is emptied when full), and characters of the longest kept.
REMEMBERED, LONG = 250_000, 120
#: Links kept per worker, after which the table is emptied too.
LINKS = 8_000_000
ROWS = ("block bigint, slot int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups string, a int, b int, planes array<binary>")


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteVocabulary:
    """A byte-level vocabulary file of the tokenizers library, read into ranks: bytes of a token, its id, and an encoder."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without character changes are handled")
        letters = _byte_letters()
        vocabulary = model["vocab"]
        merged = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        names = [*(c for c in letters), *("".join(m) for m in merged)]
        if len(set(names)) < len(names) or any(x not in vocabulary for x in names):
            raise ValueError("a token is made by several merges, or by none")
        spelled = [bytes(letters[c] for c in x) for x in names]
        #: Ids and bytes by rank: single bytes first, then in order of merging.
        self.ids = np.array([vocabulary[x] for x in names], dtype=np.int64)
        self.sizes = np.array(list(map(len, spelled)), dtype=np.int64)
        self.encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={x: k for k, x in enumerate(spelled)},
                                        special_tokens={}).encode_ordinary


class Aligner:
    """Tokenizes and aligns texts; stretches met before are looked up.

    Per stretch known, ``numbers`` has its a tokens, b tokens and groups (-1 groups if its bytes differ), ``written`` its groups
    as text; its links, codes of a and b in one number, stand in ``codes`` from its entry of ``begins`` to the next.
    """

    def __init__(self, a_path: str, b_name: str):
        self.a = ByteVocabulary(a_path)
        self.b = encoder_of(b_name)
        parts = [self.b.raw.get(i, b"") for i in range(max(self.b.surface) + 1)]
        self.b_begins, self.b_bytes = np.cumsum([0, *map(len, parts)]), np.frombuffer(b"".join(parts), np.uint8)
        self.b_bits = max(1, (len(parts) - 1).bit_length())
        if int(self.a.ids.max()).bit_length() + self.b_bits > 47:
            raise ValueError("ids of both vocabularies must fit into 47 bits together")
        joined = "".join(sorted({a for a, b in self.b.neighbours if b in STOPS}))
        self.split = re.compile(rf"(?<=[^\s{MARK}])(?= )|(?<=[^\W_{re.escape(joined)}])(?=[{STOPS}])").split
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.written: list[str] = []
        self.numbers = np.zeros((0, 3), dtype=np.int64)
        self.codes, self.begins = np.zeros(0, np.uint64), np.zeros(1, np.int64)

    def learn(self, stretches: set[str]) -> None:
        new = list(stretches - self.known.keys())
        if len(self.written) + len(new) > REMEMBERED or len(self.codes) > LINKS:
            self.clear()
            new = list(stretches)
        if not new:
            return
        ranks = [self.a.encode(x) for x in new]
        split = [self.b.split(x.replace(" ", MARK)) for x in new]
        marked = set().union(*split)
        b_known = self.b.learned(marked)
        at = np.fromiter(chain.from_iterable(map(b_known.__getitem__, x) for x in split), np.int64)
        b_ids, b_sizes = self.b.ids_at(at)
        per = np.r_[0, np.cumsum(b_sizes)][np.cumsum([0, *map(len, split)])]
        self._add(new, np.fromiter(chain.from_iterable(ranks), np.int64), np.cumsum([0, *map(len, ranks)]), b_ids, per)
        self.b.forget_long(marked)

    def _add(self, texts: list[str], ranks: np.ndarray, a_begins: np.ndarray, b_ids: np.ndarray, b_begins: np.ndarray) -> None:
        """Align all new stretches at once, as one row of bytes.

        Every stretch between two neighbouring ends of tokens of either kind lies in one a and one b token, and is their only
        common one: these are the links. Ends of both kinds cut groups.
        """
        n = len(texts)
        data = [x.encode("utf-8") for x in texts]
        edges = np.cumsum([0, *map(len, data)])
        b_sizes = self.b_begins[b_ids + 1] - self.b_begins[b_ids]
        lengths = np.diff(np.r_[0, np.cumsum(b_sizes)][b_begins])
        good = lengths == np.diff(edges)
        a_of, b_of = np.repeat(np.arange(n), np.diff(a_begins)), np.repeat(np.arange(n), np.diff(b_begins))
        kept = good[b_of]
        spelled = self.b_bytes[_stretched(self.b_begins[b_ids[kept]], b_sizes[kept])]
        text = np.frombuffer(b"".join(x for x, ok in zip(data, good) if ok), np.uint8)
        good[np.repeat(np.arange(n), np.where(good, lengths, 0))[spelled != text]] = False
        a_keep, b_keep = good[a_of], good[b_of]
        a_of, b_of, ranks, b_ids, b_sizes = a_of[a_keep], b_of[b_keep], ranks[a_keep], b_ids[b_keep], b_sizes[b_keep]
        a_ids = self.a.ids[ranks]
        a_ends, b_ends = np.cumsum(self.a.sizes[ranks]), np.cumsum(b_sizes)
        ends = np.union1d(a_ends, b_ends)
        left, right = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        of_group = a_of[np.searchsorted(a_ends, shared)]
        groups = np.where(good, np.bincount(of_group, minlength=n), -1)
        # The groups as text: each token with what stands behind it, in order of group and side.
        last_a, last_b = np.r_[a_group[1:] != a_group[:-1], True], np.r_[b_group[1:] != b_group[:-1], True]
        tokens = [f"{i}|" if last else f"{i}," for i, last in zip(a_ids.tolist(), last_a.tolist())] \
            + [f"{i};" if last else f"{i}," for i, last in zip(b_ids.tolist(), last_b.tolist())]
        order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable").tolist()
        tokens = [tokens[k] for k in order]
        cuts = np.cumsum([0, *(np.bincount(a_of, minlength=n) + np.bincount(b_of, minlength=n)).tolist()]).tolist()
        self.known.update(zip(texts, range(len(self.written), len(self.written) + n)))
        self.written += ["".join(tokens[lo:hi])[:-1] for lo, hi in zip(cuts[:-1], cuts[1:])]
        codes = a_ids[left].astype(np.uint64) << np.uint64(self.b_bits) | b_ids[right].astype(np.uint64)
        self.codes = np.concatenate([self.codes, codes])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.bincount(a_of[left], minlength=n))])
        self.numbers = np.concatenate([self.numbers, np.column_stack([np.diff(a_begins), np.diff(b_begins), groups])])

    def forget_long(self, stretches: set[str]) -> None:
        for x in stretches:
            if len(x) > LONG:
                self.written[self.known.pop(x)] = ""

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text the number of a tokens, b tokens, groups and links, and its groups as text; and over all texts the links,
        as number of the text and code, in order of text."""
        split = [self.split(" " + t) if t else [] for t in texts]
        wanted = set().union(*split)
        self.learn(wanted)
        numbers, codes, begins = self.numbers, self.codes, self.begins
        sizes = np.array(list(map(len, split)), dtype=np.int64)
        at = np.fromiter(chain.from_iterable(map(self.known.__getitem__, s) for s in split), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), dtype=bool)
        bad[owner[numbers[at, 2] < 0]] = True
        fine = ~bad[owner]
        at, owner = at[fine], owner[fine]
        totals = np.zeros((len(texts), 4), dtype=np.int64)
        np.add.at(totals[:, :3], owner, numbers[at])
        lengths = begins[at + 1] - begins[at]
        places = _stretched(begins[at], lengths)
        text = np.repeat(owner, lengths)
        totals[:, 3] = np.bincount(text, minlength=len(texts))
        written = ["" if b else ";".join([self.written[self.known[x]] for x in s]) for s, b in zip(split, bad, strict=True)]
        self.forget_long(wanted)
        return totals, written, text, codes[places]


def planes_of(keys: np.ndarray, counts: np.ndarray, b_bits: int, block: int) -> pa.RecordBatch:
    """Posting rows of one block. ``keys`` (code and 16 bits of place) are different and sorted; ``counts`` are links."""
    code = keys >> np.uint64(16)
    slot = (keys & np.uint64(BLOCK - 1)).astype(np.uint16)
    new = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
    pair = np.cumsum(new) - 1
    pairs = code[new]
    parts, plane = [], 0
    while len(counts) and (counts >> plane).any():
        at = np.flatnonzero(counts >> plane & 1)
        parts.append((pair[at] * 64 + plane, slot[at]))
        plane += 1
    labels = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    slots = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint16)
    order = np.argsort(labels, kind="stable")
    labels, slots = labels[order], slots[order]
    top = np.zeros(len(pairs), dtype=np.int64)              # planes of each pair, empty ones below its highest included
    np.maximum.at(top, labels >> 6, (labels & 63) + 1)
    base = np.r_[0, np.cumsum(top)]
    where = base[labels >> 6] + (labels & 63)
    sizes = np.bincount(where, minlength=base[-1])
    data = slots.tobytes()
    if sizes.max(initial=0) >= DENSE:                       # long lists are shorter as bits
        edges, out = np.r_[0, np.cumsum(sizes)], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi - lo >= DENSE:
                bits = np.zeros(BLOCK, dtype=bool)
                bits[slots[lo:hi]] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            else:
                out.append(data[2 * lo:2 * hi])
        values = pa.array(out, pa.binary())
    else:
        offsets = np.r_[0, 2 * np.cumsum(sizes)].astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    planes = pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), values)
    n = len(pairs)
    return _row_batch(n, block=np.full(n, block), a=(pairs >> np.uint64(b_bits)).astype(np.int32),
                      b=(pairs & np.uint64((1 << b_bits) - 1)).astype(np.int32), planes=planes)


_TYPES = {"block": pa.int64(), "slot": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
          "n_links": pa.int64(), "groups": pa.string(), "a": pa.int32(), "b": pa.int32(), "planes": pa.list_(pa.binary())}


def _row_batch(n: int, **columns) -> pa.RecordBatch:
    full = [pa.nulls(n, kind) if name not in columns else columns[name] if isinstance(columns[name], pa.Array)
            else pa.array(columns[name], kind) for name, kind in _TYPES.items()]
    return pa.RecordBatch.from_arrays(full, names=list(_TYPES))


def members(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, plane and place of every set bit of a column of planes."""
    if not len(planes):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint16)
    lists = planes.offsets.to_numpy().astype(np.int64)
    values = planes.flatten()
    per_row = np.diff(lists)
    row = np.repeat(np.arange(len(planes)), per_row)
    plane = np.arange(len(values)) - np.repeat(lists[:-1] - lists[0], per_row)
    raw = values.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int32)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = np.frombuffer(raw[2], dtype=np.uint8) if len(values) and raw[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets.astype(np.int64))
    dense = sizes == BLOCK // 8
    if not dense.any():
        places = data[offsets[0]:offsets[-1]].view(np.uint16)
        return np.repeat(row, sizes // 2), np.repeat(plane, sizes // 2), places
    parts = []
    for k in range(len(values)):
        piece = data[offsets[k]:offsets[k + 1]]
        parts.append(np.flatnonzero(np.unpackbits(piece, bitorder="little")).astype(np.uint16) if dense[k] else piece.view(np.uint16))
    lengths = np.array([len(p) for p in parts])
    return np.repeat(row, lengths), np.repeat(plane, lengths), np.concatenate(parts)


def popcounts(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (planes joined by OR, counted) and links (planes counted, weighted by 2^k) of every row."""
    row, plane, place = members(planes)
    links = np.zeros(len(planes), dtype=np.int64)
    np.add.at(links, row, np.int64(1) << plane)
    joined = np.unique(row << 16 | place)
    return np.bincount(joined >> 16, minlength=len(planes)), links


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def index(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
          postings: int = POSTINGS) -> DataFrame:
    """The staged index: one row per text (``planes`` null) and one per pair of ids and block (``slot`` null).

    Text rows have ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` (``a1,a2|b1;a3|b2,b3``, or its SHA-256
    if ``digest``). Texts that are null or empty, or whose tokens do not give back their bytes, have no tokens: zeros and ''.
    """
    names = _ship(docs.sparkSession, a_path), _ship(docs.sparkSession, b_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names not in _ALIGNERS:
            _ALIGNERS[names] = Aligner(SparkFiles.get(names[0]), names[1])
        aligner = _ALIGNERS[names]
        block, used, held, n_held = TaskContext.get().partitionId() << 32, 0, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")         # a pair's places of all pieces come together: the OR of their bitmaps
            whole = planes_of(keys[order], counts[order], aligner.b_bits, block)
            for lo in range(0, whole.num_rows, 20_000):
                yield whole.slice(lo, 20_000)

        for batch in slices(batches, limit=2 << 20):
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                if held and (used + part.num_rows > BLOCK or n_held > postings):
                    yield from closed()
                    block, used, held, n_held = block + 1, 0, [], 0
                totals, written, text, codes = aligner.align(part.column("text").to_pylist())
                keys, counts = np.unique(codes << np.uint64(16) | (text + used).astype(np.uint64), return_counts=True)
                if digest:
                    written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
                n = part.num_rows
                yield _row_batch(n, block=np.full(n, block), slot=np.arange(used, used + n, dtype=np.int32), doc_id=part.column("doc_id"),
                                 n_a=totals[:, 0], n_b=totals[:, 1], n_groups=totals[:, 2], n_links=totals[:, 3], groups=pa.array(written, pa.string()))
                held.append((keys, counts))
                used, n_held = used + n, n_held + len(keys)
        if held:
            yield from closed()

    return stage(keyed_texts(docs, id_col, text_col).mapInArrow(work, ROWS), "pair_index")


def pair_counts(found: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n_docs``, ``n_links`` and ``best`` (no other a has more links with this b) of every pair of an index."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, links = popcounts(batch.column("planes"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(docs, pa.int64()), pa.array(links)],
                                             names=["a", "b", "n_docs", "n_links"])

    counts = stage(found.filter("planes is not null").select("a", "b", "planes").mapInArrow(work, "a int, b int, n_docs bigint, n_links bigint")
                   .groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")), "pair_counts")
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def scores(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``block``, ``slot``, ``n_best`` and ``count_sum`` of every text with links: the counts sent back along the postings."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now, np.int64)), pa.array(at.astype(np.int32)), pa.array(best[at]),
                                               pa.array(total[at])], names=["block", "slot", "n_best", "count_sum"])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)] if len(blocks) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if blocks[lo] != now:
                    if now is not None:
                        yield done()
                    now, best, total = int(blocks[lo]), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
                part = batch.slice(int(lo), int(hi - lo))
                row, plane, place = members(part.column("planes"))
                times = np.int64(1) << plane
                np.add.at(total, place, times * part.column("n_links").to_numpy()[row])
                np.add.at(best, place, times * part.column("best").to_numpy(zero_copy_only=False)[row])
        if now is not None:
            yield done()

    postings = found.filter("planes is not null").select("block", "a", "b", "planes").join(counts.select("a", "b", "n_links", "best"), ["a", "b"])
    return postings.select("block", "n_links", "best", "planes").repartition("block").sortWithinPartitions("block") \
        .mapInArrow(work, "block bigint, slot int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
          postings: int = POSTINGS) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups`` of each row.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a merge-type SentencePiece model; a text is read
    with one space before it. ``n_best`` counts links whose pair has the most links of all pairs with its b id (ties included);
    ``count_sum`` adds up each link's number of links in the corpus. Null and empty texts and texts whose tokens do not give
    back their bytes have zeros and ''. Repeated rows count each; null ids stay; other columns are not read; an empty table
    gives an empty result. A long text is aligned whole.
    """
    found = index(docs, a_path, b_path, id_col, text_col, digest, postings)
    scored = scores(found, stage(pair_counts(found), "pair_best"))
    texts = found.filter("slot is not null").select("block", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = F.lit(0).cast("bigint")
    return texts.join(scored, ["block", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups")
