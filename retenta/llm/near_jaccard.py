"""Near copies by the Jaccard similarity of word runs: groups connected by links of at least a given similarity.

Two rounds of SimHash keys join most of a family of near copies cheaply; the round after them is exact and finds every link
between the components that are left.

* Fingerprints of 64 bits are split into six blocks; three of six blocks of one fingerprint (20 keys), then two of six of another
  (15 keys) are keys. Rows of a small key are compared all with all, those of a larger one with the row nearest to the majority of
  their bits, or from the smaller component. Candidates are compared by the bits, then run by run. What these rounds miss costs time only.
* Exact: if all sets are put in one order of runs, two sets of a similarity of t or more have a run in common among the first
  ``n - ceil(t * n) + 1`` of each. Each such run is a key. The order puts runs that are frequent in a sample last; any order is right,
  this one keeps keys small. Rows of one component need no link. Two sets are looked at where they meet first: each row of a key has
  the least runs before it in four other orders with it, and a pair that shares one of them is left to that key. A key of at most ``SMALL`` rows gives its pairs, held against sizes
  and places, then against counts of runs by their last byte, which bound what two sets have in common; a larger one with several components is compared run by run inside tasks, in blocks of at most ``BLOCK`` rows, from
  the rows outside its largest component, and gives a spanning forest of the links found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from retenta.llm.arrow import keyed_texts, slices
from retenta.llm.components import components
from retenta.session import scratch, stage

PRINTS, BLOCKS = 3, 6
_EDGES = [0, 11, 22, 33, 43, 53, 64]
#: Fingerprints and blocks per key of each round, and whether rows of large keys are compared with every other component.
ROUNDS = (((0,), 3, False), ((1,), 2, True))
#: Differing bits of half of another fingerprint: 4.9 are expected at 0.8 (standard deviation 2), 16 for unrelated sets.
LOOSE = 10
#: Share of differing bits of all fingerprints: 0.152 at 0.8 (standard deviation 0.026).
FAR = 0.22
#: Rows of a key up to which all its pairs are looked at: in the first round, and in those where other keys are looked at component
#: by component.
FEW, SMALL = 8, 32
#: Half the rows of a larger key that are compared at once in the exact round.
BLOCK = 2048
#: Odd numbers that put runs of 32 bits in another order, one to one.
ORDERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Pairs that a task of the exact round holds, to name each once.
PAIRS = 1 << 20
#: Sets whose runs are counted to order them, and runs that are kept as frequent ones.
SAMPLE, FREQUENT = 20_000, 1 << 18
#: Runs that are put in order at once: some 20 numbers of 64 bits are held for each.
ORDERED = 1 << 18


def runs(text: bytes, size: int) -> np.ndarray:
    """Sorted different hashes of the runs of ``size`` words (A-Z lower-cased, ASCII white space); a shorter text is one run."""
    import xxhash
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i:i + size]), 42) for i in range(n)), dtype=np.uint64, count=n))


def prints(hashes: np.ndarray) -> np.ndarray:
    """``PRINTS`` fingerprints of 64 bits: a bit is 1 if it is set in over half of the hashes, which are mixed anew for each."""
    total, n = np.zeros(64 * PRINTS, dtype=np.int64), len(hashes)
    salts = np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, n, 255):
        x = hashes[lo:lo + 255, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little").view("<u8")


def _counts(runs: np.ndarray) -> bytes:
    """Size of the set, and how many of its runs (255 at most) end in each of 256 values."""
    return np.uint32(len(runs)).tobytes() + np.minimum(np.bincount(runs & 255, minlength=256), 255).astype(np.uint8).tobytes()


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """The columns of ``rows`` but ``text``, and ``node`` (hash of the run set), ``prints``, ``runs`` (32 bits of each) and ``counts``."""
    import xxhash
    names = [c for c in rows.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, marks, sets, counts = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist():
                found = runs(text, size)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
                marks.append(prints(found).view(np.int64))
                sets.append(np.unique((found >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                counts.append(_counts(sets[-1]))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, PRINTS * len(nodes) + 1, PRINTS, dtype=np.int32)), pa.array(np.concatenate(marks))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))),
                 pa.array(counts, pa.binary())], names=[*names, "node", "prints", "runs", "counts"])

    kept = ", ".join(f"{c} bigint" for c in names)
    return rows.select(*names, "text").mapInArrow(work, f"{kept}, node bigint, prints array<bigint>, runs array<int>, counts binary")


def _keys(batches: Iterator[pa.RecordBatch], chosen: tuple[int, ...], blocks: int) -> Iterator[pa.RecordBatch]:
    """Every key of every node in one round, as the number of its blocks and their bits, with half of another fingerprint."""
    choices = list(combinations(range(BLOCKS), blocks))
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.asarray(batch.column("prints").flatten()).view(np.uint64).reshape(-1, PRINTS)
        for r in chosen:
            other = (marks[:, (r + 1) % PRINTS] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for k, choice in enumerate(choices):
                key = np.full(len(marks), r * len(choices) + k, dtype=np.uint64)
                for block in choice:
                    width = _EDGES[block + 1] - _EDGES[block]
                    bits = (marks[:, r] >> np.uint64(_EDGES[block])) & np.uint64((1 << width) - 1)
                    key = key << np.uint64(width) | bits
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("component"), batch.column("node"), pa.array(other)],
                                                 names=["key", "component", "node", "other"])


def _star(trees: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the row nearest to the majority of all bits to the close rows of other components."""
    bits = np.unpackbits(marks.view(np.uint8).reshape(-1, 4), axis=1)
    middle = np.packbits(2 * bits.sum(0) > len(bits)).view(np.uint32)[0]
    centre = int(np.argmin(np.bitwise_count(marks ^ middle)))
    close = np.flatnonzero((np.bitwise_count(marks ^ marks[centre]) <= LOOSE) & (trees != trees[centre]))
    return np.full(len(close), centre), close


def _across(trees: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row to the nearest close row of every larger component; two components are linked by the rows of the smaller."""
    _, of, sizes = np.unique(trees, return_inverse=True, return_counts=True)
    place = np.empty(len(sizes), dtype=np.int64)
    place[np.argsort(sizes, kind="stable")] = np.arange(len(sizes))
    of = place[of]
    a, b = [], []
    for i in np.flatnonzero(of < len(sizes) - 1).tolist():
        far = np.bitwise_count(marks ^ marks[i])
        near = np.flatnonzero((far <= LOOSE) & (of > of[i]))
        if len(near):
            near = near[np.argsort(far[near], kind="stable")]
            near = near[np.unique(of[near], return_index=True)[1]]
            a.append(np.full(len(near), i))
            b.append(near)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(rows: np.ndarray, whole: bool) -> pa.RecordBatch:
    """Candidate links of rows (key, component, node, other) in order of key."""
    key, trees, nodes, marks = rows[:, 0], rows[:, 1], rows[:, 2], np.ascontiguousarray(rows[:, 3]).astype(np.int32).view(np.uint32)
    cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(rows)]
    sizes = np.diff(cuts)
    a, b = [], []
    small = SMALL if whole else FEW
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    for lag in range(1, small):
        at = at[at + lag < len(rows)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        near = at[(np.bitwise_count(marks[at] ^ marks[at + lag]) <= LOOSE) & (trees[at] != trees[at + lag])]
        a.append(nodes[near])
        b.append(nodes[near + lag])
    for k in np.flatnonzero(sizes > small):
        lo, hi = cuts[k], cuts[k + 1]
        if (trees[lo:hi] != trees[lo]).any():
            x, y = (_across if whole else _star)(trees[lo:hi], marks[lo:hi])
            a.append(nodes[lo + x])
            b.append(nodes[lo + y])
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Candidate links of rows sorted by key; the rows of one key may cross batches."""
    for rows in _whole_keys(batches):
        yield _links(rows, whole)


def _sides(links: DataFrame, table: DataFrame, column: str) -> DataFrame:
    return links.join(table.select(F.col("node").alias("a"), F.col(column).alias("x")), "a") \
        .join(table.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")


def _similar(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links of a similarity of ``least`` or more. Only the sets that some link names are shuffled for the comparison."""
    ends = stage(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    same = F.size(F.array_intersect("x", "y"))
    return _sides(links, sets.join(ends, "node", "left_semi"), "runs").filter(same >= F.lit(least) * (F.size("x") + F.size("y") - same)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The candidate links at a similarity of ``least`` or more. Few are left when the runs themselves are read."""
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = stage(_sides(pairs, nodes, "prints").filter(differ <= FAR * 64 * PRINTS).select("a", "b"), "close")
    return _similar(close, sets, least)


# --------------------------------------------------------------- the exact round
def _possible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose counts leave room for a similarity of ``least``: no more runs can be in common than the smaller counts add up to."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, 260) for c in ("x", "y"))
        sizes = x[:, :4].copy().view("<u4")[:, 0].astype(float) + y[:, :4].copy().view("<u4")[:, 0]
        fewer = np.minimum(x[:, 4:], y[:, 4:])
        most = fewer.sum(1, dtype=np.int64)
        good = (most * (1 + least) + 1e-6 >= least * sizes) | (fewer == 255).any(1)       # 255 may stand for more
        yield batch.filter(pa.array(good)).select(["a", "b"])


def frequent_runs(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs found often in a sample of the sets, sorted, and how often; at most ``FREQUENT``. They only set the order of runs."""
    every = max(1, sets.count() // SAMPLE)
    sample = sets.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select(F.explode("runs").alias("run"))
    found = sample.groupBy("run").count().filter("count >= 3").orderBy(F.desc("count"), "run").limit(FREQUENT).collect()
    table = np.array(sorted((r["run"], r["count"]) for r in found), dtype=np.int64).reshape(-1, 2)
    return table[:, 0].copy(), table[:, 1].copy()


def _leading(batches: Iterator[pa.RecordBatch], often: tuple[np.ndarray, np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    """The leading runs of every set in the common order, with the size of the set, the place of the run, and the least of the runs
    before it in each of four other orders, two to a column. Those change seldom along a set and pack well."""
    known, counts = often
    for batch in slices(batches, "runs", ORDERED):
        flat, ends = batch.column("runs").flatten().to_numpy().astype(np.int64), batch.column("runs").offsets.to_numpy().astype(np.int64)
        sizes = np.diff(ends)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        count = np.zeros(len(flat), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            count = np.where(known[at] == flat, counts[at], 0)
        order = np.lexsort((flat, count, owner))
        place = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
        needed = np.ceil(least * sizes - 1e-9).astype(np.int64)
        first = place < (sizes - needed + 1)[owner]
        of, owned, key = pa.array(owner[first]), owner[first], flat[order][first]
        # Later sets have the lower upper half, so that the running minimum starts anew with each.
        turn = (np.uint64(len(sizes)) - owned.astype(np.uint64)) << np.uint64(32)
        least_of = [np.roll(np.minimum.accumulate(turn | (key.astype(np.uint64) * np.uint64(m) & np.uint64(0xFFFFFFFF))), 1) for m in ORDERS]
        low = [x & np.uint64(0xFFFFFFFF) for x in least_of]
        before = [(low[i] | low[i + 1] << np.uint64(32)).view(np.int64) for i in (0, 2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), batch.column("component").take(of), batch.column("node").take(of), pa.array(sizes[owned]),
             pa.array(place[first]), *map(pa.array, before)], names=["key", "component", "node", "size", "place", "before1", "before2"])


def _met(place: np.ndarray, before: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows ``x`` and ``y`` of one key have a least run before it in common: their sets meet there already."""
    found = np.zeros(len(x), dtype=bool)
    for column in before:
        differ = (column[x] ^ column[y]).view(np.uint64)
        found |= (differ & np.uint64(0xFFFFFFFF) == 0) | (differ >> np.uint64(32) == 0)
    return found & (place[x] > 0) & (place[y] > 0)


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows sorted by their first column, as arrays in which no key is open."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held and held[0][0, 0] == rows[-1, 0]:
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows])
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if last:
            yield rows[:last]
        held = [rows[last:]]
    if held:
        yield np.concatenate(held)


def _candidates(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (key, component, node, size, place, before1, before2) sorted by key and component: pairs ``a``, ``b`` of small keys, and the rows
    ``a`` of larger keys of several components with the block pairs (``key``, ``part``) in which they are compared.

    A pair is looked at where its sets meet first: a key is passed over if a run before it is seen to be a key of both.
    """
    names = ["key", "part", "component", "a", "b"]
    seen: list[np.ndarray] = []

    def pairs_of(found: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), axis=0)

    def small(pairs: np.ndarray) -> pa.RecordBatch:
        zero = pa.array(np.zeros(len(pairs), dtype=np.int64))
        return pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)

    for rows in _whole_keys(batches):
        key, tree, node, size, place, *before = rows.T
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(rows)]
        lengths = np.diff(cuts)
        mixed = tree[cuts[:-1]] != tree[cuts[1:] - 1]
        at = np.flatnonzero(np.repeat(mixed & (lengths <= SMALL), lengths))
        for lag in range(1, SMALL):
            at = at[at + lag < len(rows)]
            at = at[key[at] == key[at + lag]]
            if not len(at):
                break
            to = at + lag
            # What two sets can have in common from their first common run on, against what the similarity needs.
            rest = np.minimum(size[at] - place[at], size[to] - place[to])
            good = (tree[at] != tree[to]) & (rest * (1 + least) + 1e-6 >= least * (size[at] + size[to]))
            good[good] = ~_met(place, tuple(before), at[good], to[good])
            a, b = node[at[good]], node[to[good]]
            if len(a):
                seen.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
        if sum(map(len, seen)) > PAIRS:
            seen = [pairs_of(seen)]
            if len(seen[0]) > PAIRS // 2:
                yield small(seen[0])
                seen = []
        parts = []
        for k in np.flatnonzero(mixed & (lengths > SMALL)):
            one = np.column_stack([key[cuts[k]:cuts[k + 1]], np.zeros(lengths[k], dtype=np.int64), tree[cuts[k]:cuts[k + 1]],
                                   node[cuts[k]:cuts[k + 1]], np.zeros(lengths[k], dtype=np.int64)])
            count = -(-len(one) // BLOCK)
            for i, j in combinations(range(count), 2) if count > 2 else [(0, 1)]:
                both = np.concatenate([one[x * BLOCK:(x + 1) * BLOCK] for x in (i, j)])
                if both[0, 2] != both[-1, 2]:
                    both[:, 1] = 1 + i * count + j
                    parts.append(both)
                if len(parts) >= 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(parts).T.copy()], names=names)
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(parts).T.copy()], names=names)
    yield small(pairs_of(seen))


def _forest(trees: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the components that are connected by pairs of sets at a similarity of ``least`` or more."""
    _, of, counts = np.unique(trees, return_inverse=True, return_counts=True)
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    root = np.arange(len(counts))
    links = []
    for i in np.flatnonzero(of != int(np.argmax(counts))).tolist():
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        found = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(int((hi - lo).sum()))
        same = np.bincount(owner[found], minlength=len(sets))
        near = np.flatnonzero((same >= least * (sizes + sizes[i] - same)) & (root[of] != root[of[i]]))
        for j in near[np.unique(root[of[near]], return_index=True)[1]].tolist():
            links.append((i, j))
            root[root == root[of[j]]] = root[of[i]]
    return links


def _compare_sets(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links found among the rows (key, part, component, node, runs) of each key and part, by which they are sorted."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        group = rows.combine_chunks()
        column = group.column("runs").combine_chunks()
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
        sets = np.split(flat, (ends[1:-1] - ends[0]).astype(np.int64))
        node = group.column("node").to_numpy()
        found = np.array(_forest(group.column("component").to_numpy(), sets, least), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])

    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        name = np.column_stack([batch.column(c).to_numpy() for c in ("key", "part")])
        cuts = np.r_[0, np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1, len(name)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if now is not None and tuple(name[lo]) != now:
                yield links(pa.Table.from_batches(held))
                held = []
            now = tuple(name[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield links(pa.Table.from_batches(held))


def _exact_links(placed: DataFrame, least: float) -> DataFrame:
    """Links of a similarity of ``least`` or more that connect all components of ``placed`` (node, component, runs) which any connects."""
    often = frequent_runs(placed)
    found = stage(placed.mapInArrow(lambda x: _leading(x, often, least), "key bigint, component bigint, node bigint, size bigint, place bigint, "
                                         "before1 bigint, before2 bigint")
                  .repartition("key").sortWithinPartitions("key", "component", "node")
                  .mapInArrow(lambda x: _candidates(x, least), "key bigint, part bigint, component bigint, a bigint, b bigint"), "pairs")
    sets = placed.select("node", "runs")
    small = _sides(found.filter("part = 0").select("a", "b").distinct(), placed, "counts")
    small = _similar(stage(small.select("a", "b", "x", "y").mapInArrow(lambda x: _possible(x, least), "a bigint, b bigint"), "close"), sets, least)
    large = found.filter("part > 0").select("key", "part", "component", F.col("a").alias("node")).join(sets, "node") \
        .select("key", "part", "component", "node", "runs").repartition("key", "part").sortWithinPartitions("key", "part") \
        .mapInArrow(lambda x: _compare_sets(x, least), "a bigint, b bigint")
    return small.union(large)


def near_groups(rows: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The columns of ``rows`` (bigints) but ``text``, and ``component``, equal for rows connected by links of a Jaccard
    similarity of ``least`` or more between their sets of ``size``-word runs; staged.

    Texts without words (null, empty, blank) are one group. Ids may be null or repeated: they are handed through. An empty
    table gives an empty result. Similarity is decided on 32 bits of each run's hash.
    """
    spark = rows.sparkSession
    with scratch(spark):
        found = stage(sketches(rows, size), "sketches")
        nodes = stage(found.select("node", "prints", "runs", "counts").dropDuplicates(["node"]), "nodes")
        named = None

        def placed() -> DataFrame:
            return nodes.withColumn("component", F.col("node")) if named is None else \
                nodes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))

        def joined(links: DataFrame) -> DataFrame:
            if named is not None:
                links = links.union(named.select(F.col("node").alias("a"), F.col("component").alias("b")))
            return stage(components(links), "components")

        for chosen, blocks, whole in ROUNDS:
            links = placed().select("node", "prints", "component") \
                .mapInArrow(lambda x, c=chosen, n=blocks: _keys(x, c, n), "key bigint, component bigint, node bigint, other int") \
                .repartition("key").sortWithinPartitions("key", "component", "node") \
                .mapInArrow(lambda x, w=whole: _compare(x, w), "a bigint, b bigint")
            named = joined(_verified(stage(links.distinct(), "pairs"), nodes, nodes, least))
        named = joined(_exact_links(placed().select("node", "component", "runs", "counts"), least))
        return stage(found.drop("prints", "runs", "counts").join(named, "node", "left").select(
            *[c for c in rows.columns if c != "text"], F.coalesce("component", "node").alias("component")), "groups", lasting=True)


def one_of_each(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest ``doc_id``, then the smallest hash of its text.

    Rows without an id come last and stay only where no other row of the group does. Rows are told apart by id and text, so that
    of two texts of one id each goes its own way; of rows equal in both one stays, the smallest by the other columns.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.xxhash64(F.lit(k), F.col("doc_id").cast("bigint"), text) for k in (1, 2)]
    keyed = keyed_texts(docs).select("doc_id", *[F.xxhash64(F.lit(k), "doc_id", "text").alias(f"row{k}") for k in (1, 2)], "text")
    groups = near_groups(keyed, size, least)
    kept = groups.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "row1", "row2")).alias("kept"))
    groups = stage(kept.filter("n > 1").select("component", "kept.row1", "kept.row2"), "kept") \
        .join(groups.select("component", F.col("row1").alias("r1"), F.col("row2").alias("r2")), "component") \
        .groupBy("r1", "r2").agg(F.bool_or((F.col("r1") == F.col("row1")) & (F.col("r2") == F.col("row2"))).alias("stays"),
                                 F.count("*").alias("n"))
    marked = stage(groups.filter("not stays or n > 1"), "copies")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, row[0].alias("r1"), row[1].alias("r2"))
    single = rows.join(marked, ["r1", "r2"], "left_anti").select("doc")
    repeated = rows.join(marked.filter("stays"), ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.min("doc").alias("doc"))
    return single.union(repeated.select("doc")).select("doc.*")
