"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct five-word shingles. Documents with equal sets are one node. A node's MinHash samples
make banded keys, which find candidates, and an odd sketch: each one-permutation sample toggles one bit of a bitmap, so
that the popcount of two bitmaps' XOR estimates how many samples differ. It is precise for high similarities, and
candidates below the threshold fall out on it. The others are confirmed on their full sets.

No group is expanded into its pairs. In each band every node is first held against one pivot; the confirmed links make
components. Only bands that still hold two components are held against themselves, in blocks of bounded size, so what the
pivots did not connect is held against all the rest. The nodes that the sketches let pass there go on in groups, not as
pairs, and a group gives the links that join its components: rows follow the nodes, even where many texts are just below
the threshold, and large groups of copies cost one pair each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import Tables, add_by_text, ascii_lower, without

WORDS, SIMILAR = 5, 75
#: 32 bands of 4: a pair at the threshold shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: An odd sketch folds the one-permutation samples of so many bins into so many bits.
BINS, BITS = 8192, 8192
#: Standard deviations that an estimate at the threshold may fall short before a pair is dropped unconfirmed.
SIGMAS = 5.5
#: Ids that are broadcast at most; more are shuffled.
BROADCAST_IDS = 500_000

_U = np.uint64
_rng = np.random.default_rng(75)
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_WORD = _rng.integers(1, 2**63, 64, dtype=_U) * _U(2) + _U(1)
_MUL = (_rng.integers(1, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WHITE, _NEXT_WHITE = b"\t\n\x0b\x0c\r ", re.compile(rb"[\t-\r ]").search
#: Bytes of a text whose words are hashed at once.
PIECE = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _cumulated(base: int) -> np.ndarray:
    a = np.full(PIECE, base, dtype=_U)
    a[0] = 1
    return np.cumprod(a, dtype=_U)


_POWER, _INVERSE = _cumulated(_BASE), _cumulated(pow(_BASE, -1, 1 << 64))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut at white space into pieces of ``PIECE`` bytes at most; a longer word is a piece of its own."""
    lo = 0
    while len(raw) - lo > PIECE:
        hi = lo + PIECE
        if raw[hi] not in _WHITE:
            hi = max(raw.rfind(c, lo, hi) for c in _WHITE)
            if hi < 0:
                end = _NEXT_WHITE(raw, lo + PIECE)
                hi = end.start() if end else len(raw)
        yield raw[lo:hi]
        lo = hi + 1
    yield raw[lo:]


def _piece_hashes(raw: bytes) -> np.ndarray:
    if len(raw) > PIECE:  # one word
        return np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), dtype=_U)
    buf = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[buf].view(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(buf) + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * _POWER[: len(buf)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _INVERSE[starts])


def word_hashes(raw: bytes) -> np.ndarray:
    r"""A 64-bit hash of each word ``[^\x20\x09-\x0D]+`` of the lower-cased text, in order; besides the result, memory
    follows ``PIECE`` and the longest word."""
    raw = ascii_lower(raw)
    if len(raw) <= PIECE:
        return _piece_hashes(raw) if raw else np.empty(0, dtype=_U)
    return np.concatenate([_piece_hashes(x) for x in _pieces(raw) if x])


def shingles(raw: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles; a shorter text is one shingle, an empty one none."""
    words = word_hashes(raw or b"")
    if not len(words):
        return words
    wide = min(size, len(words))
    n = len(words) - wide + 1
    acc = np.full(n, _U(wide), dtype=_U)
    for k in range(wide):
        acc += words[k : k + n] * _WORD[k]
    return np.unique(_mix(acc))


def minhash(items: np.ndarray) -> np.ndarray:
    small = (items >> _U(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(small), 1024):
        part = small[k : k + 1024, None] * _MUL
        part += _ADD
        np.minimum(out, part.min(axis=0), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    """One key per band and text (a row of ``samples``), the band's number folded in."""
    pairs = samples.astype(_U).reshape(len(samples), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), pairs.shape[:2])
    for k in range(ROWS):
        acc = _mix(acc * _U(_BASE) + pairs[:, :, k])
    return acc.view(np.int64)


def bin_samples(items: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: of each of ``BINS`` ranges of the hash the least item, if there is one. A small set is
    sampled whole, or nearly so."""
    bins = (items >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    return items[np.flatnonzero(np.diff(bins, prepend=-1))]


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """A bitmap of ``BITS`` bits in which every sample toggles one. A sample tells its own bin."""
    odd = np.bincount((_mix(samples) % _U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    """100 * intersection >= percent * union, on sorted sets."""
    if not len(a) or not len(b):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


_FIELDS = [
    T.StructField("n_shingles", T.LongType(), False),
    T.StructField("__set", T.BinaryType()),
    T.StructField("__bands", T.ArrayType(T.LongType())),
    T.StructField("__sketch", T.ArrayType(T.LongType())),
    T.StructField("__samples", T.IntegerType()),
]


def _key(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _signatures() -> Callable:
    def compute(texts: list[bytes | None]) -> list[list]:
        rows, samples = [], []
        for raw in texts:
            items = shingles(raw)
            if len(items):
                own = bin_samples(items)
                samples.append(minhash(items))
                rows.append([len(items), _key(items), None, odd_sketch(own), len(own)])
            else:
                rows.append([0, None, None, None, None])
        keys = iter(bands(np.stack(samples)) if samples else ())
        for row in rows:
            row[2] = next(keys) if row[0] else None
        return list(map(list, zip(*rows, strict=True)))

    return compute


def _keys(with_items: bool) -> Callable:
    def compute(texts: list[bytes | None]) -> list[list]:
        sets = [shingles(x) for x in texts]
        keys = [_key(x) if len(x) else None for x in sets]
        return [keys, [x.tobytes() for x in sets] if with_items else [len(x) for x in sets]]

    return compute


def close(n_a, s_a, sketch_a, n_b, s_b, sketch_b) -> np.ndarray:
    """Whether pairs of nodes (sizes, sample counts, sketches; arrays that broadcast) may be similar.

    Their sizes must allow it, and their sketches speak for it: the XOR has p bits, which stand for
    D = ln(1 - 2p/BITS) / ln(1 - 2/BITS) samples of one node alone. At the threshold J the nodes' union has
    U = (n_a + n_b) / (1 + J) items in B = BINS * (1 - exp(-U / BINS)) bins, of which J * B are expected to agree. Fewer
    by ``SIGMAS`` deviations of the sampling (without replacement) and of the folding: not similar.
    """
    j = SIMILAR / 100
    bits = np.bitwise_count((sketch_a ^ sketch_b).view(_U)).sum(axis=-1, dtype=np.int64)  # of a signed word it counts the magnitude
    agree = (s_a + s_b - np.log(np.maximum(1 - 2 * bits / BITS, 1e-9)) / math.log(1 - 2 / BITS)) / 2
    union = (n_a + n_b) / (1 + j)
    used = BINS * -np.expm1(-union / BINS)
    share = j * used / (BINS * -(np.expm1(-n_a / BINS) + np.expm1(-n_b / BINS)))
    want = share * (s_a + s_b)  # of the samples at hand: how many bins they fill by chance cancels out
    apart = np.maximum(s_a + s_b - 2 * want, 0)
    spread = used * j * (1 - j) * (1 - used / union) + (BITS / 4 * np.expm1(4 * apart / BITS) - apart) / 4 + 0.5
    sized = 100 * np.minimum(n_a, n_b) >= SIMILAR * np.maximum(n_a, n_b)
    return sized & (agree >= want - SIGMAS * np.sqrt(spread))


#: Nodes of a band and size class that are held against each other at once, about so many on either side.
BLOCK = 1024
#: Nodes that are held against one copy of their pivot, about.
GROUP = 256
#: Pairs whose sketches are compared at once.
_AT_ONCE = 8192
_PAIRS = "a long, b long"
#: A group of candidates: its nodes, their components, and which of the others each is to be compared with.
_GROUPS = "key string, node long, root long, others array<long>"
#: Shingles of either side of a group, about, or one node's.
GROUP_ITEMS = 1 << 19
#: Sizes of similar sets differ by a factor of 4 / 3 at most, so their classes by 1 at most.
_CLASS = 1.34


def _signed(flat: list, wide: list) -> tuple[np.ndarray, ...]:
    """Numbers as arrays, lists of numbers as rows of a matrix."""
    return *[x.to_numpy(zero_copy_only=False) for x in flat], *[x.flatten().to_numpy().reshape(len(x), -1) for x in wide]


def with_pivots(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (node and values) of the pairs (a, b), sorted within partitions by ``a`` and ``part``: the pivot's own row
    (``b`` null) first, then those held against it. A pivot of many pairs is repeated for every ``GROUP`` of them, so no
    group grows with the input and no value of a pivot is sent once per pair."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    heads = heads.select("a", "part", F.lit(None).cast("bigint").alias("b"), F.col("a").alias("node"))
    tails = pairs.select("a", "b").join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b", F.col("b").alias("node"))
    both = heads.unionByName(tails).join(rows, "node").drop("node")
    return both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())


def _close_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of :func:`with_pivots` rows that are close; the last pivot is carried over batches."""
    pivot = None
    for batch in batches:
        a, n, s, sketch = _signed([batch.column("a"), batch.column("n_shingles"), batch.column("__samples")], [batch.column("__sketch")])
        b = batch.column("b")
        head = b.is_null().to_numpy(zero_copy_only=False)
        at = np.cumsum(head) - 1
        own = np.flatnonzero(head)
        p_n, p_s, p_sketch = n[own], s[own], sketch[own]
        if len(at) and at[0] < 0:
            p_n, p_s, p_sketch = np.append(pivot[0], p_n), np.append(pivot[1], p_s), np.concatenate((pivot[2][None], p_sketch))
            at = at + 1
        if len(at):
            pivot = p_n[-1], p_s[-1], p_sketch[-1].copy()
        b = b.fill_null(0).to_numpy(zero_copy_only=False)
        tail = np.flatnonzero(~head)
        for k in range(0, len(tail), _AT_ONCE):
            i = tail[k : k + _AT_ONCE]
            j = at[i]
            i = i[close(p_n[j], p_s[j], p_sketch[j], n[i], s[i], sketch[i])]
            yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[i])], names=["a", "b"])


def _similar_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_close_stars` on full sets."""
    pivot = None
    for batch in batches:
        out: tuple[list[int], list[int]] = ([], [])
        for a, b, items in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("__items"), strict=True):
            items = np.frombuffer(items.as_buffer(), dtype=_U)
            if b is None:
                pivot = items.copy()
            elif similar(pivot, items):
                out[0].append(a)
                out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])


def _cell_pairs(x: tuple, y: tuple | None, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the close pairs across components of two cells of a band (of one cell: ``y`` is None), each in the first
    band it shares."""
    places_a, places_b = [], []
    y, inside = (x, True) if y is None else (y, False)
    step = max(1, (1 << 20) // max(1, len(x[0])))
    for lo in range(0, len(y[0]), step):
        hi = min(lo + step, len(y[0]))
        low, high = np.minimum(x[2][:, None], y[2][None, lo:hi]), np.maximum(x[2][:, None], y[2][None, lo:hi])
        ok = (x[1][:, None] != y[1][None, lo:hi]) & (100 * low >= SIMILAR * high)
        if inside:
            ok &= np.arange(len(x[0]))[:, None] < np.arange(lo, hi)[None]
        all_i, all_k = np.nonzero(ok)
        for at in range(0, len(all_i), _AT_ONCE):
            i, k = all_i[at : at + _AT_ONCE], all_k[at : at + _AT_ONCE] + lo
            good = close(x[2][i], x[3][i], x[4][i], y[2][k], y[3][k], y[4][k])
            i, k = i[good], k[good]
            same = x[5][i] == y[5][k]
            first = x[5][i, same.argmax(axis=1)] == band if len(i) else np.zeros(0, dtype=bool)
            places_a.append(i[first])
            places_b.append(k[first])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *places_a]), np.concatenate([none, *places_b])


def _grouped(x: tuple, y: tuple, i: np.ndarray, k: np.ndarray, key: str) -> Iterator[pa.RecordBatch]:
    """The pairs (x at ``i``, y at ``k``) as groups (``_GROUPS``) of ``GROUP_ITEMS`` shingles on either side, about: one row
    for each node of a group."""

    def part(z: tuple, at: np.ndarray) -> np.ndarray:
        used, back = np.unique(at, return_inverse=True)
        return (np.cumsum(z[2][used]) // GROUP_ITEMS)[back]

    if not len(i):
        return
    part_x, part_y = part(x, i), part(y, k)
    order = np.lexsort((i, part_y, part_x))
    i, k, part_x, part_y = i[order], k[order], part_x[order], part_y[order]
    edges = np.flatnonzero((np.diff(part_x, prepend=-1) != 0) | (np.diff(part_y, prepend=-1) != 0)).tolist()
    for lo, hi in zip(edges, [*edges[1:], len(i)], strict=True):
        a, b = x[0][i[lo:hi]], y[0][k[lo:hi]]
        nodes, at = np.unique(np.concatenate((a, b)), return_index=True)
        roots = np.concatenate((x[1][i[lo:hi]], y[1][k[lo:hi]]))[at]
        place = np.searchsorted(nodes, a)
        ends = np.cumsum(np.bincount(place + 1, minlength=len(nodes) + 1)).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(ends), pa.array(b[np.argsort(place, kind="stable")]))
        yield pa.RecordBatch.from_arrays([pa.array([f"{key}:{part_x[lo]}:{part_y[lo]}"] * len(nodes)), pa.array(nodes), pa.array(roots), others], names=["key", "node", "root", "others"])


def _cross_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key`` and ``side``: the nodes of one cell (side 0), then those of another (1), or of one cell that
    is held against itself (2). Only the first cell is kept, the other streams by."""
    key, side, band, x, n = None, 0, 0, [], 0

    def result(y):
        whole = tuple(np.concatenate(z) for z in zip(*x, strict=True))
        return _grouped(whole, y or whole, *_cell_pairs(whole, y, band), f"{key}:{n}")

    for batch in batches:
        names = ("node", "root", "n_shingles", "__samples")
        rows = _signed([batch.column(c) for c in names], [batch.column("__sketch"), batch.column("__bands")])
        keys, sides, in_band = batch.column("key").to_pylist(), batch.column("side").to_pylist(), batch.column("band").to_pylist()
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or sides[i] != sides[i - 1]), len(keys)]
        for lo, hi in zip(edges, edges[1:]):  # noqa: B905
            if lo == hi:
                continue
            part = tuple(z[lo:hi] for z in rows)
            if keys[lo] != key:
                if side == 2 and x:
                    yield from result(None)
                key, band, x, n = keys[lo], in_band[lo], [], 0
            side = sides[lo]
            if side == 1:
                yield from result(part)
                n += 1
            else:
                x.append(tuple(z.copy() for z in part))
    if side == 2 and x:
        yield from result(None)


def _joining(nodes: np.ndarray, roots: np.ndarray, others: list[np.ndarray], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Similar pairs of a group that join its components. A pair that such pairs have joined already is not compared; all
    others of ``others`` are, on full sets."""
    order = np.argsort(nodes)
    ends = np.cumsum([0, *map(len, sets)])
    items = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes, marked = np.diff(ends), np.zeros(len(items), dtype=bool)
    roots = roots.copy()
    out: tuple[list[int], list[int]] = ([], [])
    for i, other in enumerate(others):
        k = order[np.searchsorted(nodes, other, sorter=order)]
        k = k[roots[k] != roots[i]]
        if not len(k):
            continue
        own = items[ends[i] : ends[i + 1]]
        marked[own] = True
        both = np.array([np.count_nonzero(marked[items[ends[j] : ends[j + 1]]]) for j in k.tolist()])
        marked[own] = False
        for j in k[100 * both >= SIMILAR * (sizes[i] + sizes[k] - both)].tolist():
            if roots[j] != roots[i]:
                out[0].append(int(nodes[i]))
                out[1].append(int(nodes[j]))
                roots[roots == roots[j]] = roots[i]
    return out


def _similar_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of groups: rows sorted by ``key``, with ``__items``. One group is held at a time."""
    key, held = None, []

    def result():
        nodes, roots, others, sets = zip(*held, strict=True)
        links = _joining(np.array(nodes), np.array(roots), [np.array(x, dtype=np.int64) for x in others], list(sets))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "node", "root", "others")]
        for own, *row, items in zip(*columns, batch.column("__items"), strict=True):
            if own != key and held:
                yield result()
                held = []
            key = own
            held.append((*row, np.frombuffer(items.as_buffer(), dtype=_U).copy()))
    if held:
        yield result()


def full_sets(some: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node`` and ``__items`` for the nodes of ``some``, a written table. The sets are made anew from their texts."""
    wanted = nodes.select("node", "__set", "__id").join(some.distinct(), "node", "left_semi")
    ids = wanted.select(F.col("__id").alias("__want")).distinct()
    ids = F.broadcast(ids) if some.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, F.col(id_col).eqNullSafe(F.col("__want")), "left_semi")
    items = [T.StructField("__set", T.BinaryType()), T.StructField("__items", T.BinaryType())]
    sets = add_by_text(texts, text_col, partial(_keys, True), items, keep=[])
    return sets.join(wanted.select("node", "__set"), "__set").dropDuplicates(["node"]).select("node", "__items")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    return with_pivots(pairs, full_sets(ends, nodes, docs, id_col, text_col)).mapInArrow(_similar_stars, _PAIRS)


def confirm_groups(groups: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between the components of each of ``groups`` (``_GROUPS``): those that all its similar pairs join."""
    sets = full_sets(groups.select("node"), nodes, docs, id_col, text_col)
    rows = groups.join(sets, "node").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_similar_groups, _PAIRS)


#: Rows of a file of an intermediate table, about.
ROWS_A_FILE = 1 << 19


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for the nodes of ``links`` (a, b).

    Large-star and small-star steps in turn, each written to the shared folder, until every node has one link and no
    node with a link is another's end.
    """
    edges = tables.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(False).alias("root"))
        ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("n"), F.lit(True).alias("root")))
        ends = ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("root").alias("root"))
        state = ends.agg(F.count_if((F.col("n") > 1) | ((F.col("n") == 1) & F.col("root"))).alias("open"), F.sum("n").alias("n")).first()
        if not state["open"]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").distinct().coalesce(1 + state["n"] // ROWS_A_FILE)
        was, edges = edges, tables.written(small, "links")
        tables.drop(was)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _cross(tables: Tables, members: DataFrame, found: DataFrame, signed: DataFrame) -> DataFrame:
    """Groups of close nodes of different components in the bands that hold two components or more.

    A band's nodes lie in cells: by size class, by component where one fills more than a block, and by hash. Cells meet
    whose sizes allow a link and which are not of one component alone, so a large group of copies costs its outsiders
    one comparison each and itself none.
    """
    rooted = members.select("node", "band").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    size_class = F.floor(F.log(F.col("n_shingles")) / math.log(_CLASS)).alias("size_class")
    rest = rooted.join(split, "band").join(signed.select("node", size_class), "node")
    rest = tables.written(rest, "near-rest")
    large = rest.groupBy("band", "root").count().where(F.col("count") > BLOCK).select("band", "root", F.col("root").alias("own"))
    rest = rest.join(large, ["band", "root"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    blocks = rest.groupBy("band", "size_class", "own").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cell = ["band", "size_class", "own", "block"]
    rest = rest.join(blocks, cell[:3]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
    cells = rest.select(*cell).distinct()
    x, y = (cells.select("band", F.struct(*cell[1:]).alias(side)) for side in "xy")
    meet = x.join(y, "band").where("x <= y AND y.size_class <= x.size_class + 1 AND NOT (x.own = y.own AND x.own >= 0)")
    meet = meet.select("band", "x", "y", F.concat_ws(":", "band", "x.*", "y.*").alias("key"), (F.col("x") == F.col("y")).alias("same"))
    first = meet.select("key", F.when(F.col("same"), 2).otherwise(0).alias("side"), "band", "x.*")
    other = meet.where("NOT same").select("key", F.lit(1).alias("side"), "band", "y.*")
    rows = first.unionByName(other).join(rest, cell).select("key", "side", "band", "node", "root")
    rows = rows.join(signed, "node").repartition("key").sortWithinPartitions("key", "side")
    return rows.mapInArrow(_cross_cells, _GROUPS)


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends are not of one component."""
    for side in "ab":
        roots = found.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(roots, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a <> root_b").select("a", "b")


def node_links(tables: Tables, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Components of the nodes: ``node`` and ``root`` for every node with a link.

    Three passes, each over what the ones before left apart: every node against the least of its bands' pivots, against
    the pivots of its other bands, and against the nodes of other components in its bands.
    """
    exploded = nodes.select("node", F.explode("__bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = tables.written(exploded.join(shared, "band"), "near-members")  # node, band, a: bands of two nodes or more
    signed = nodes.select("node", "n_shingles", "__samples", "__sketch", "__bands")
    pivots = members.where("node <> a").select("a", F.col("node").alias("b"))

    def close_to_pivots(pairs: DataFrame) -> DataFrame:
        return tables.written(with_pivots(pairs, signed.drop("__bands")).mapInArrow(_close_stars, _PAIRS), "near-stars")

    def joined_by(found: DataFrame, candidates: DataFrame, by: Callable = confirm) -> DataFrame:
        if candidates.isEmpty():
            return found
        chains = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return components(tables, chains.unionByName(by(candidates, nodes, docs, id_col, text_col)))

    none = nodes.sparkSession.createDataFrame([], "node long, root long")
    stars = close_to_pivots(pivots.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = joined_by(none, stars)
    more = close_to_pivots(_across(pivots.distinct(), found).join(stars, ["a", "b"], "left_anti"))
    found = joined_by(found, more)
    return joined_by(found, tables.written(_cross(tables, members, found, signed), "near-cross"), confirm_groups)


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sets that two rows share or that are linked with another: ``__set`` (key of a shingle set), ``component_id``,
    ``__root`` (the group's own key: groups of unlike texts may have one id in common) and ``n_first`` (rows of the group
    that carry that id); and for each row of ``docs`` its id, ``n_shingles`` and ``__set`` (null for an empty set)."""
    source = docs.select(F.col(id_col), F.col(text_col))
    with Tables(docs.sparkSession) as tables:
        signed = tables.written(add_by_text(source, text_col, _signatures, _FIELDS, keep=[id_col]), "near-signed")
        some = signed.where("__set is not null")
        nodes = some.groupBy("__set").agg(
            F.min(id_col).alias("__id"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"),
            F.first("__bands").alias("__bands"), F.first("__sketch").alias("__sketch"), F.first("__samples").alias("__samples"),
        )
        nodes = tables.written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
        found = node_links(tables, nodes, source, id_col, text_col)
        placed = nodes.select("node", "__set", "__id", "n_docs").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = placed.groupBy("root").agg(F.min("__id").alias("component_id"), F.sum("n_docs").alias("n_group"))
        classes = placed.join(least.where("n_group > 1"), "root").select("__set", "component_id", F.col("root").alias("__root"))
        first = some.join(classes, "__set").where(F.col(id_col).eqNullSafe(F.col("component_id")))
        first = first.groupBy("__root").agg(F.count("*").alias("n_first"))
        classes = tables.written(classes.join(first, "__root", "left"), "near-classes")
        return tables.keep(classes), tables.keep(signed).select(id_col, "n_shingles", "__set")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_shingles``, ``component_id`` (the smallest id reachable over links, the row's own included) and ``kept``
    (whether that is the row's id) to each row. ``keep``: the input columns to return (the id alone by default).

    Links: 100 * intersection >= 75 * union of the five-word shingle sets of the lower-cased (A-Z) texts. A text with
    fewer words is one shingle; a null or empty text has an empty set, is linked with nothing and kept. Null ids count
    only where a group has no other. Rows that repeat an id are rows of their own and all kept if it is the smallest;
    :func:`drop_duplicates` leaves one. An input column with the name of a new one is replaced.
    """
    return _placed(docs, id_col, text_col, keep, *duplicate_classes(docs, id_col, text_col)).drop("__root", "n_first")


def _placed(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None, classes: DataFrame, rows: DataFrame) -> DataFrame:
    if keep and keep != [id_col]:
        fields = [T.StructField("__set", T.BinaryType()), T.StructField("n_shingles", T.LongType(), False)]
        rows = without(docs, ["component_id", "kept", "n_first", "__root", "__set"])
        rows = add_by_text(rows, text_col, partial(_keys, False), fields, keep=keep)
    out = rows.join(classes.withColumn("__in", F.lit(True)), "__set", "left").drop("__set")
    out = out.withColumn("component_id", F.when(F.col("__in"), F.col("component_id")).otherwise(F.col(id_col)))
    return out.drop("__in").withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group; all columns stay, whatever their names."""
    classes, rows = duplicate_classes(docs, id_col, text_col)
    if rows.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty():
        gone = rows.join(classes, "__set").where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone"))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")  # the ids tell the rows apart: texts stay where they are
    renamed = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    back = [F.col(v).alias(c) for c, v in renamed.items()]
    marked = _placed(docs.toDF(*renamed.values()), renamed[id_col], renamed[text_col], list(renamed.values()), classes, rows).where("kept")
    if classes.where("n_first > 1").isEmpty():
        return marked.select(*back)
    many = F.coalesce(F.col("n_first"), F.lit(1)) > 1
    again = marked.where(many).dropDuplicates(["__root"])
    return marked.where(~many).unionByName(again).select(*back)
