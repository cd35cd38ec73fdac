"""SentencePiece encoding and decoding for merge-type vocabularies: an agenda of adjacent symbol pairs, best score first.

Every character starts as a symbol. All neighbouring pairs whose joint text is a piece stand on an agenda, ordered by score
and then by place from the left. The first is merged, its new neighbours are put on the agenda, and entries whose symbols have
changed meanwhile are skipped, so a run of n characters takes about n log n steps. A piece of a vocabulary with a space mark at
its head only never reaches across the start of a run of marks: texts are cut there, and equal stretches are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from retenta.llm.arrow import keyed_texts, slices
from retenta.llm.bpe import _ship

MARK = "▁"
#: Stretches kept per worker; the table is emptied when full. Longer stretches are encoded anew each time.
REMEMBERED, LONG = 400_000, 200
#: Characters up to which stretches are merged many at a time; rank of pairs that make no piece.
FEW, NONE = 40, 1 << 30


class PieceEncoder:
    """Encoder and decoder for one model file.

    The model must merge (not be a unigram model), change no characters, set a mark before the text, and have no
    user-defined or unused pieces; anything else is an error, as results would differ from the library's.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or rules.precompiled_charsmap or not rules.add_dummy_prefix \
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models without character changes and with a leading mark are handled")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.pieces = list(self.ids.values())
        #: Symbols by number: pieces, then single characters that only stand inside pieces.
        self.symbols = [*self.ids, *sorted(set().union(*self.ids) - self.ids.keys())]
        self.number = {x: k for k, x in enumerate(self.symbols)}
        scores = np.array([model.pieces[i].score for i in self.ids.values()], dtype=np.float64)
        order = np.unique(-scores, return_inverse=True)[1].tolist()          # equal scores get equal ranks
        #: Rank and number of the piece that two symbols make.
        self.rank, self.joint = {}, {}
        for piece, rank in zip(self.ids, order, strict=True):
            for cut in range(1, len(piece)):
                left, right = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if left is not None and right is not None:
                    self.rank[left << 24 | right], self.joint[left << 24 | right] = rank, self.number[piece]
        keys = sorted(self.rank)
        none = np.iinfo(np.int64).max
        self._keys = np.array([*keys, none], dtype=np.int64)
        self._ranks = np.array([*map(self.rank.get, keys), NONE], dtype=np.int32)
        self._joints = np.array([*map(self.joint.get, keys), -1], dtype=np.int32)
        self._chars = np.full(0x110000, -1, dtype=np.int32)
        for x, k in self.number.items():
            if len(x) == 1:
                self._chars[ord(x)] = k
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.raw = {i: bytes([b]) for b, i in self.byte_ids.items()}         # bytes a token stands for in the marked text
        self.surface = dict(self.raw)                                       # bytes it decodes to
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.raw[i] = p.piece.replace(MARK, " ").encode("utf-8")
                self.surface[i] = self.raw[i]
            elif p.type == kinds.CONTROL:
                self.surface[i] = b""
            elif p.type == kinds.UNKNOWN:
                self.surface[i] = model.trainer_spec.unk_surface.encode("utf-8")
        self.headed = {i for p, i in self.ids.items() if p.startswith(MARK)}
        cut = not any(MARK in p.lstrip(MARK) for p in self.ids)
        #: Neighbouring characters within pieces; no token reaches across two others.
        self.neighbours = {pair for piece in self.ids for pair in pairwise(piece)}
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cut else "(?s:.+)").findall
        self.library = SentencePieceProcessor(model_file=path)
        self._named_ids = np.full(len(self.symbols), -1, dtype=np.int32)
        self._named_ids[:len(self.pieces)] = self.pieces
        parts = [self.surface[i] for i in range(len(model.pieces))]
        self._surface_begins, self._surface_bytes = np.cumsum([0, *map(len, parts)]), np.frombuffer(b"".join(parts), np.uint8)
        self._headed = np.array([i in self.headed for i in range(len(parts))], dtype=np.int64)
        self.clear()

    def merged(self, marked: str) -> list[int]:
        """The symbols that are left of a marked text when no two neighbours make a piece; a character unknown to the model is
        its negative code point less one."""
        number = self.number.get
        return self._many([number(c, -1 - ord(c)) for c in marked], self.rank.get, self.joint)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair in ``self._keys``, or that of the entry behind them."""
        key = left.astype(np.int64) << 24 | right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, at, len(self._keys) - 1)

    def _together(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of many short texts, one text after the other, and how many each has; as ``merged``. Each text is a
        row of symbols with an agenda of ranks beside it; in every round the first best pair of each row is merged."""
        sizes = np.array(list(map(len, names)))
        width, n = int(sizes.max()), len(names)
        points = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        inside = np.arange(width) < sizes[:, None]
        row = np.full((n, width), NONE - (1 << 29), dtype=np.int32)       # no symbol has this number
        found = self._chars[points]
        row[inside] = np.where(found >= 0, found, -1 - points)
        agenda = self._ranks[self._pair(row[:, :-1], row[:, 1:])] if width > 1 else np.zeros((n, 0), np.int32)
        done, left, at, spots = [], np.zeros(n, np.int64), np.arange(n), np.arange(width)
        while True:
            best = agenda.argmin(1) if agenda.shape[1] else np.zeros(len(at), np.int64)
            open_ = agenda[np.arange(len(at)), best] < NONE if agenda.shape[1] else np.zeros(len(at), bool)
            left[at[~open_]] = sizes[~open_]
            done.append((at[~open_], row[~open_][spots[:row.shape[1]] < sizes[~open_, None]]))
            if not open_.any():
                begins, out = np.cumsum(left) - left, np.zeros(left.sum(), np.int32)
                for rows, symbols in done:
                    out[_stretched(begins[rows], left[rows])] = symbols
                return out, left
            at, row, agenda, sizes, i = at[open_], row[open_], agenda[open_], sizes[open_] - 1, best[open_]
            width = int(sizes.max())
            every = np.arange(len(at))
            piece = self._joints[self._pair(row[every, i], row[every, i + 1])]
            before, behind = row[every, np.maximum(i - 1, 0)], row[every, np.minimum(i + 2, row.shape[1] - 1)]
            last = i + 1 >= sizes                                       # nothing stands behind the merged pair
            row = np.take_along_axis(row, spots[:width] + (spots[:width] > i[:, None]), 1)
            row[every, i] = piece
            if width == 1:
                agenda = np.zeros((len(at), 0), np.int32)
                continue
            agenda = np.take_along_axis(agenda, np.minimum(spots[:width - 1] + (spots[:width - 1] >= i[:, None]), agenda.shape[1] - 1), 1)
            agenda[np.arange(width - 1) >= sizes[:, None] - 1] = NONE
            agenda[every[i > 0], i[i > 0] - 1] = self._ranks[self._pair(before[i > 0], piece[i > 0])]
            agenda[every[~last], i[~last]] = self._ranks[self._pair(piece[~last], behind[~last])]

    @staticmethod
    def _many(row: list[int], rank, joint) -> list[int]:
        """The agenda of a long row is a heap of rank and place; entries whose pair has changed since are skipped."""
        n = len(row)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        agenda = [r << 40 | i for i, (a, b) in enumerate(pairwise(row)) if (r := rank(a << 24 | b)) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & (1 << 40) - 1
            j = after[i]
            if gone[i] or j >= n or rank(row[i] << 24 | row[j]) != entry >> 40:
                continue
            piece = row[i] = joint[row[i] << 24 | row[j]]
            gone[j] = True
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(piece << 24 | row[k])
                if r is not None:
                    heappush(agenda, r << 40 | i)
            h = before[i]
            if h >= 0:
                r = rank(row[h] << 24 | piece)
                if r is not None:
                    heappush(agenda, r << 40 | h)
        return [x for x, out in zip(row, gone) if not out]

    def stretch(self, marked: str) -> tuple[int, ...]:
        """Ids of a marked text."""
        return self._named(self.merged(marked))

    def _named(self, row: list[int]) -> tuple[int, ...]:
        """Ids of symbols; characters without a piece become their bytes, or the unknown id."""
        if row and min(row) >= 0 and max(row) < len(self.pieces):
            return tuple(map(self.pieces.__getitem__, row))
        ids, symbols = self.ids, self.symbols
        out: list[int] = []
        for x in row:
            symbol = symbols[x] if x >= 0 else chr(-1 - x)
            if symbol in ids:
                out.append(ids[symbol])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in symbol.encode("utf-8")]
            else:
                out.append(self.unknown)
        return tuple(out)

    def marked(self, text: str) -> list[str]:
        """The stretches of a text, with marks for spaces and one before it; an empty text has none."""
        return self.split(MARK + text.replace(" ", MARK)) if text else []

    def clear(self) -> None:
        self._known: dict[str, int] = {}
        self._begins, self._flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self._wrong: set[str] = set()

    def learned(self, stretches: set[str], check: bool = False) -> dict[str, int]:
        """The number of every stretch asked for, under which ``ids_at`` has its ids. With ``check``, new ones are held against the
        library as one batch."""
        new = stretches - self._known.keys()
        if len(self._begins) + len(new) > REMEMBERED or len(self._flat) > 8 * REMEMBERED:
            self.clear()
            new = stretches
        short: dict[int, list[str]] = {}    # of similar length, so that rows waste little
        for name in new:
            short.setdefault(len(name) // 4 if len(name) <= FEW else -1, []).append(name)
        for of, group in short.items():
            for lo in range(0, len(group), 50_000):
                names = group[lo:lo + 50_000]
                if of < 0:
                    rows = list(map(self.stretch, names))
                    ids, sizes = np.array(list(chain.from_iterable(rows)), np.int32), np.array(list(map(len, rows)))
                else:
                    ids, sizes = self._ids(*self._together(names))
                self._known.update(zip(names, range(len(self._begins) - 1, len(self._begins) - 1 + len(names))))
                self._begins = np.concatenate([self._begins, self._begins[-1] + np.cumsum(sizes)])
                self._flat = np.concatenate([self._flat, ids])
        if check:                           # the library sets the first mark itself, and gives nothing for nothing
            names = [x for x in new if len(x) > 1]
            theirs = self.library.encode([x[1:] for x in names], num_threads=1)
            numbers = np.fromiter(map(self._known.__getitem__, names), np.int64, len(names))
            sizes = np.fromiter(map(len, theirs), np.int64, len(names))
            same = sizes == self._begins[numbers + 1] - self._begins[numbers]
            flat = np.fromiter(chain.from_iterable(x for x, ok in zip(theirs, same) if ok), np.int32)
            odd = self._flat[_stretched(self._begins[numbers[same]], sizes[same])] != flat
            same[np.repeat(np.flatnonzero(same), sizes[same])[odd]] = False
            self._wrong.update(names[k] for k in np.flatnonzero(~same))
        return self._known

    def _ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for rows of symbols; symbols that are no piece are written out one by one."""
        ids = np.where(symbols >= 0, self._named_ids[np.maximum(symbols, 0)], -1)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, sizes
        lengths, parts = np.ones(len(ids), np.int64), [self._named([int(x)]) for x in symbols[odd]]
        lengths[odd] = list(map(len, parts))
        out = np.repeat(ids, lengths)
        out[out < 0] = list(chain.from_iterable(parts))
        return out, np.diff(np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(sizes)]])

    def ids_at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches, one after the other, and how many each has."""
        sizes = self._begins[numbers + 1] - self._begins[numbers]
        return self._flat[_stretched(self._begins[numbers], sizes)], sizes

    def forget_long(self, stretches: set[str]) -> None:
        for name in stretches:
            if len(name) > LONG:
                self._known.pop(name, None)

    def encoded(self, texts: Iterable[str], check: bool = False) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """The ids of all texts, where those of each begin, and whether none of its stretches differed from the library."""
        split = [self.marked(t) for t in texts]
        wanted = set().union(*split)
        known = self.learned(wanted, check)
        at = np.fromiter(chain.from_iterable(map(known.__getitem__, s) for s in split), np.int64, sum(map(len, split)))
        ids, sizes = self.ids_at(at)
        begins = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, split)])]
        agrees = [not self._wrong or self._wrong.isdisjoint(s) for s in split]
        self.forget_long(wanted)
        return ids, begins, agrees

    def encode(self, texts: Iterable[str], check: bool = False) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether none of its stretches differed from the library."""
        ids, begins, agrees = self.encoded(texts, check)
        return [ids[lo:hi] for lo, hi in zip(begins[:-1], begins[1:])], agrees

    def decoded(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The texts of many rows of ids, as ``decode``."""
        sizes = self._surface_begins[ids + 1] - self._surface_begins[ids]
        data = self._surface_bytes[_stretched(self._surface_begins[ids], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][begins]
        full = begins[:-1] < begins[1:]
        skip = np.zeros(len(begins) - 1, np.int64)
        skip[full] = self._headed[ids[begins[:-1][full]]]
        keep = np.ones(len(data), bool)
        keep[ends[:-1][skip > 0]] = False
        offsets = np.r_[0, np.cumsum(np.diff(ends) - skip)].astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(skip), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes())])
        try:
            if not (sizes == 0).any():      # only control ids decode to nothing
                out.validate(full=True)
                return out
        except pa.ArrowInvalid:
            pass
        return pa.array([self.decode(ids[lo:hi].tolist()) for lo, hi in zip(begins[:-1], begins[1:])], pa.string())

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the mark set before it, bytes read as UTF-8, each byte that is none as U+FFFD."""
        skip = next((1 if i in self.headed else 0 for i in ids if i not in self.control), 0)
        out = []
        for control, run in groupby(ids, self.control.__contains__) if not self.control.isdisjoint(ids) else [(False, ids)]:
            if not control:                 # bytes on either side of a control id are no one character
                joined = b"".join(map(self.surface.__getitem__, run))
                try:
                    out.append(joined.decode("utf-8"))
                except UnicodeDecodeError:
                    out.append(_repaired(joined))
        return "".join(out)[skip:]


def _stretched(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches that begin here and are so long, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _repaired(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as wrong:
            out.append(data[at:at + wrong.start].decode("utf-8") + "�")
            at += wrong.start + 1
    return "".join(out)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(name: str) -> PieceEncoder:
    """One encoder per worker process, read from the file that Spark sent to the executor."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(SparkFiles.get(name))
    return _ENCODERS[name]


def _lists(ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True,
           decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>, no begin or end ids), ``agrees`` and, if asked, ``decoded`` per row.

    With ``check``, each stretch that is new to a worker is also encoded by the library, one call per Arrow batch; ``agrees``
    is false for texts with a stretch on which the two differ. Null and empty texts give an empty array; repeated rows and
    null ids stay as they are; other columns are not read; an empty table gives an empty result. Long texts are whole; a
    stretch without any space is one agenda.
    """
    name = _ship(docs.sparkSession, model_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name)
        for batch in slices(batches, limit=2 << 20):
            ids, begins, agrees = encoder.encoded(batch.column("text").to_pylist(), check)
            columns = [batch.column("doc_id"), _lists(ids, begins), pa.array(agrees, pa.bool_())]
            if decoded:
                columns.append(encoder.decoded(ids, begins))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "agrees", "decoded"][:len(columns)])

    schema = "doc_id bigint, ids array<int>, agrees boolean" + (", decoded string" if decoded else "")
    return keyed_texts(docs, id_col, text_col).mapInArrow(work, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` per row; a null array counts as empty."""
    name = _ship(encoded.sparkSession, model_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name)
        for batch in batches:
            texts = pa.array([encoder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "decoded"])

    return encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                          F.col(f"`{ids_col}`").cast("array<int>").alias("ids")) \
        .mapInArrow(work, "doc_id bigint, decoded string")


def differences(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``library_ids`` of the rows whose whole text the library encodes otherwise."""
    name = _ship(docs.sparkSession, model_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name)
        for batch in slices(batches, limit=2 << 20):
            texts = batch.column("text").to_pylist()
            ours, theirs = encoder.encode(texts)[0], [np.array(x, np.int32) for x in encoder.library.encode(texts, num_threads=1)]
            odd = [k for k, (x, y) in enumerate(zip(ours, theirs, strict=True)) if not np.array_equal(x, y)]
            columns = [pa.array([x[k].tolist() for k in odd], pa.list_(pa.int32())) for x in (ours, theirs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(odd, pa.int64())), *columns], names=["doc_id", "ids", "library_ids"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, ids array<int>, library_ids array<int>")
