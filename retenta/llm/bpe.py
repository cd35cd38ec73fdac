"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A sequence of tokens is the BPE encoding of its bytes exactly when every neighbouring pair is, so each prefix of a
byte string has one valid last token. Storing that token per prefix gives the encoding of any prefix by walking back,
lets bytes be appended without starting over, and limits the work after an edit to what stands behind it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from retenta.llm.arrow import keyed_texts, slices

REMEMBERED = 300_000
#: Bytes of text whose matches are held as Python strings at once.
PIECE = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encoder for one table of ranks.

    ``last_tokens(data)`` returns the valid last token of every prefix; ``append`` and ``edit`` bring such a list up
    to date; ``tokens`` reads the encoding off it. Memory for remembered pairs and pieces is bounded: the tables are
    emptied when full.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; null if it is one byte, or if merging never makes it."""
        if token not in self._parts:
            data, ranks = self.bytes_of[token], self.ranks
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == 1 << 60:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._parts[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self._parts[token]

    def _makes(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._halves(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; a left of -1 stands for the start.

        The merges of both tokens are undone, latest first. If at any time the two parts at the border could have
        merged before the merge that is undone next, the pair is not an encoding.
        """
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= 4 * REMEMBERED:
                self._pairs.clear()
            known = self._makes(right) and (left < 0 or self._makes(left) and self._keeps_border(left, right))
            self._pairs[(left, right)] = known
        return known

    def _keeps_border(self, left: int, right: int) -> bool:
        ranks, bytes_of, until = self.ranks, self.bytes_of, 1 << 60
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], until) < until:
                return False
            made_left = left if len(bytes_of[left]) > 1 else -1
            made_right = right if len(bytes_of[right]) > 1 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                until, left = left, self._halves(left)[1]
            else:                           # of equal merges the left one comes first, so a border merge of that rank wins
                until, right = right + 1, self._halves(right)[0]

    def last_tokens(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """``result[i]`` is the last token of the encoding of ``data[:i + 1]``; ``known`` is kept as a prefix."""
        last = list(known or ())
        get, longest, pairs, fits = self.ranks.get, self.longest, self._pairs, self.fits
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(data[start:end])
                if token is not None:
                    left = last[start - 1] if start else -1
                    ok = pairs.get((left, token))
                    if ok or ok is None and fits(left, token):
                        last.append(token)
                        break
            else:
                raise ValueError("the rank table lacks a single byte")
        return last

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The data and table after ``more`` is added; nothing before it is computed again."""
        return data + more, self.last_tokens(data + more, last)

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``data[start:end]``. Prefixes before the edit stay. Behind it, the old table holds again once a run
        as long as the longest token repeats, for no token reaches back further."""
        edited, shift = data[:start] + new + data[end:], len(new) - (end - start)
        table, same = last[:start], 0
        while len(table) < len(edited):
            step = min(len(edited), len(table) + 2 * self.longest)
            at, table = len(table), self.last_tokens(edited[:step], table)
            for at in range(at, step):
                old = at - shift
                same = same + 1 if old >= end and table[at] == last[old] else 0
                if same >= self.longest:
                    return edited, table[:at + 1] + last[old + 1:]
        return edited, table

    def tokens(self, data: bytes, last: list[int]) -> tuple[int, ...]:
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return tuple(out[::-1])

    def pieces(self, texts: set[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of matches of the splitting pattern; a match that is itself a token stays whole.

        New matches are taken in byte order, so that each begins with the table of the prefix it shares with the one
        before it.
        """
        known = self._pieces
        new = texts - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = texts
        before, last = b"", []
        for data in sorted(x.encode("utf-8") for x in new):
            whole = self.ranks.get(data)
            if whole is not None:
                known[data.decode("utf-8")] = (whole,)
                continue
            shared, most = 0, min(len(data), len(before))
            while shared < most and data[shared] == before[shared]:
                shared += 1
            before, last = data, self.last_tokens(data, last[:shared])
            known[data.decode("utf-8")] = self.tokens(data, last)
        return known

    def encode(self, texts: list[list[str]]) -> Iterator[list[int]]:
        """Ids of each text, given as its matches of the splitting pattern."""
        known = self.pieces(set().union(*texts))
        for pieces in texts:
            ids: list[int] = []
            for found in map(known.__getitem__, pieces):
                ids += found
            yield ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(name: str) -> PrefixEncoder:
    """One encoder per worker process, read from the file that Spark sent to the executor."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PrefixEncoder(read_ranks(SparkFiles.get(name)))
    return _ENCODERS[name]


def _ship(spark: SparkSession, path: str) -> str:
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) and, if asked, ``decoded`` (the bytes of the ids, binary) per row.

    Every match of ``pattern`` is encoded separately, without special tokens. Null and empty texts give an empty array;
    repeated rows and null ids stay as they are; other columns are not read, so their names cannot clash; an empty
    table gives an empty result. A text is handled as a stream of matches, so its length is bounded by one row only.
    """
    name = _ship(docs.sparkSession, ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        encoder, split = _encoder(name), regex.compile(pattern)
        for batch in slices(batches, limit=PIECE):
            rows = list(encoder.encode([split.findall(x) for x in batch.column("text").to_pylist()]))
            columns = [batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array(map(encoder.decode, rows), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][:len(columns)])

    schema = "doc_id bigint, ids array<int>" + (", decoded binary" if decoded else "")
    return keyed_texts(docs, id_col, text_col).mapInArrow(work, schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` (binary) per row; a null array counts as empty."""
    name = _ship(encoded.sparkSession, ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in batches:
            data = pa.array((encoder.decode(x or ()) for x in batch.column("ids").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], names=["doc_id", "decoded"])

    return encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                          F.col(f"`{ids_col}`").cast("array<int>").alias("ids")) \
        .mapInArrow(work, "doc_id bigint, decoded binary")
