"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton. Training words are streamed through it: at each
word the automaton gives the longest suffix that occurs in some item. A match of at least ``window`` words, or a whole
item that is shorter than that, hits its words. Hit spans can be cut from the text, and documents with too large a hit
share dropped.

Words are mapped to numbers first. Runs of words whose neighbours never stand together in an item cannot hold a match,
so the automaton only walks the remaining runs; this skips work, never matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import add_by_text, alnum_spans, alnum_words, resident, without

WINDOW = 10
#: Items go through in blocks of at most so many bytes of text; each block makes one automaton.
BLOCK_BYTES = 4 << 20
#: More blocks are refused: all items are broadcast.
MAX_BLOCKS = 16
#: With several blocks, texts of so many bytes pass one automaton before the next is made; a worker holds one at a time.
GROUP_BYTES = 64 << 20
_BITS = 22


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of ints."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, token: int) -> int:
        at = self.next[last].get(token)
        if at is not None:
            if self.length[at] == self.length[last] + 1:
                return at
            return self._split(last, at, token)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def _split(self, p: int, q: int, token: int) -> int:
        """The state for the strings of ``q`` that end a string of ``p`` and ``token``, split off ``q``."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: list[int]) -> None:
        last = 0
        for t in tokens:
            last = self._extend(last, t)

    def states(self, tokens: list[int]) -> list[int]:
        """States after each prefix of an added sequence."""
        at, out = 0, []
        for t in tokens:
            at = self.next[at][t]
            out.append(at)
        return out


class Matcher:
    """The automaton of a block of items with what its states tell about windows and whole short items."""

    def __init__(self, items: tuple[tuple[str | None, bytes], ...], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        numbered = []
        for item_id, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in alnum_words(text)]
            if words:
                numbered.append((item_id, words))
        self.sam = sam = SuffixAutomaton()
        for _, words in numbered:
            sam.add(words)
        n = len(sam.next)
        self.owners: list[set[str]] = [set() for _ in range(n)]
        short: list[list[tuple[int, str | None]]] = [[] for _ in range(n)]
        seen = [-1] * n
        for k, (item_id, words) in enumerate(numbered):
            states = sam.states(words)
            if len(words) < window:
                short[states[-1]].append((len(words), item_id))
                continue
            for s in states:
                while s > 0 and seen[s] != k and sam.length[s] >= window:
                    seen[s] = k
                    if item_id is not None:
                        self.owners[s].add(item_id)
                    s = sam.link[s]
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * n
        for s in sorted(range(1, n), key=sam.length.__getitem__):
            self.short[s] = (*short[s], *self.short[sam.link[s]])
        self.least = min((min(len(w), window) for _, w in numbered), default=0)
        self.pairs = np.zeros(1 << _BITS, dtype=bool)
        for _, words in numbered:
            if len(words) > 1:
                a = np.asarray(words, dtype=np.int64)
                self.pairs[_pair(a[:-1], a[1:])] = True

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def runs(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words that could hold a match."""
        n, least = len(numbers), self.least
        if not least or n < least:
            return []
        if least == 1:
            flags, more = numbers > 0, 0
        else:
            flags, more = self.pairs[_pair(numbers[:-1], numbers[1:])] & (numbers[:-1] > 0) & (numbers[1:] > 0), 1
        if not flags.any():
            return []
        edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2] + more
        long = ends - starts >= least
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[bytearray | None, set[str], int]:
        """Hit mask of the words (None: no hit), the items found, and the longest match."""
        numbers = self.numbers(words)
        mask, found, longest = None, set(), 0
        nxt, link, length, window = self.sam.next, self.sam.link, self.sam.length, self.window
        for lo, hi in self.runs(numbers):
            v = size = 0
            for i, t in enumerate(numbers[lo:hi].tolist(), lo):
                while v and t not in nxt[v]:
                    v = link[v]
                    size = length[v]
                if t in nxt[v]:
                    v, size = nxt[v][t], size + 1
                else:
                    continue
                longest = max(longest, size)
                hit = 0
                if size >= window:
                    u = v
                    while length[link[u]] >= window:
                        u = link[u]
                    found |= self.owners[u]
                    hit = window
                for m, item_id in self.short[v]:
                    if m <= size:
                        hit = max(hit, m)
                        if item_id is not None:
                            found.add(item_id)
                if hit:
                    mask = mask or bytearray(len(words))
                    mask[i - hit + 1 : i + 1] = b"\x01" * hit
        return mask, found, longest


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA77) & ((1 << _BITS) - 1)


def cut(raw: bytes, matcher: Matcher) -> bytes:
    """``raw`` without its hit spans; repeats until what the cuts joined holds no match either."""
    while True:
        mask, _, _ = matcher.scan(alnum_words(raw))
        if not mask:
            return raw
        spans, out, at, k = alnum_spans(raw), [], 0, 0
        while (k := mask.find(1, k)) >= 0:
            end = mask.find(0, k)
            end = len(mask) if end < 0 else end
            out.append(raw[at : spans[k][0]])
            at = spans[end - 1][1]
            k = end
        out.append(raw[at:])
        raw = b" ".join(x for x in (y.strip(b" ") for y in out) if x)


def _digest(block: tuple) -> str:
    return hashlib.sha256(repr(block).encode()).hexdigest()


def _factory(block, key: str, window: int, clean: bool) -> Callable:
    m = resident(("items", key, window), lambda: Matcher(block.value, window))

    def compute(texts: list[bytes | None]) -> list[list]:
        rows = []
        for raw in texts:
            words = alnum_words(raw or b"")
            mask, found, longest = m.scan(words)
            n_hit = mask.count(1) if mask else 0
            row = [len(words), n_hit, sorted(found), longest]
            if clean:
                row.append(cut(raw, m).decode("utf-8", "replace") if n_hit else None)
            rows.append(row)
        return list(map(list, zip(*rows, strict=True)))

    return compute


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Items in blocks of a bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    rows = items.select(items[id_col].cast("string").alias("i"), items[text_col].cast("string").alias("t"))
    for row in rows.where("t is not null").toLocalIterator():
        raw = row.t.encode("utf-8")
        if block and size + len(raw) > block_bytes:
            yield tuple(block)
            block, size = [], 0
        block.append((row.i, raw))
        size += len(raw)
    yield tuple(block)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    clean: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds to each document the benchmark passages in it.

    New columns: ``n_words``, ``n_hit`` (words inside an occurrence of a window, or of a whole item shorter than a
    window), ``item_ids`` (sorted as strings), ``longest_match`` (words), ``contaminated``, ``coverage`` (n_hit over
    n_words, 0 without words) and, with ``clean``, ``clean_text`` (the text without hit spans).

    A null text or one without words has no hits and stays as it is. Items without words or with a null text match
    nothing; an item with a null id hits words but is not listed. Repeated documents get equal results, repeated items
    count by id, equal passages of several items list them all. No items: nothing is hit. Input columns with the name
    of a new one are replaced.

    Items are test sets: they are read in blocks of ``block_bytes`` (each one broadcast automaton). With more than one
    block the documents pass through one block after the other in the same row, so that nothing is shuffled; a block's
    automaton is made once for ``GROUP_BYTES`` of text. More than ``MAX_BLOCKS`` blocks are refused.
    """
    sc = docs.sparkSession.sparkContext
    fields = [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("item_ids", T.ArrayType(T.StringType()), False),
        T.StructField("longest_match", T.LongType(), False),
    ]
    if clean:
        fields.append(T.StructField("clean_text", T.StringType()))
    parts = []
    for part in _blocks(items, item_id_col, item_text_col, block_bytes):
        if len(parts) == MAX_BLOCKS:
            raise ValueError(f"the items hold more than {MAX_BLOCKS} blocks of {block_bytes} bytes; give them in parts")
        parts.append(part)
    blocks = [sc.broadcast(b) for b in parts]
    if len(blocks) == 1:
        out = add_by_text(docs, text_col, partial(_factory, blocks[0], _digest(parts[0]), window, clean), fields)
    else:
        out = add_by_text(docs, text_col, partial(_many, blocks, window, clean), fields, slice_bytes=GROUP_BYTES)
    if clean:
        out = out.withColumn("clean_text", F.coalesce("clean_text", F.col(text_col).cast("string")))
    out = without(out, ["contaminated", "coverage"])
    return out.withColumns(
        {
            "contaminated": F.col("n_hit") > 0,
            "coverage": F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(F.lit(0.0)),
        }
    )


def _many(blocks: list, window: int, clean: bool) -> Callable:
    """As :func:`_factory`, the union of the hits of several blocks."""

    def compute(texts: list[bytes | None]) -> list[list]:
        words = [alnum_words(raw or b"") for raw in texts]
        masks: list[bytearray | None] = [None] * len(texts)
        found: list[set[str]] = [set() for _ in texts]
        longest, cleaned = [0] * len(texts), list(texts)
        for block in blocks:
            m = Matcher(block.value, window)
            for k, w in enumerate(words):
                mask, ids, size = m.scan(w)
                found[k] |= ids
                longest[k] = max(longest[k], size)
                if mask:
                    masks[k] = bytearray(a | b for a, b in zip(masks[k], mask, strict=True)) if masks[k] else mask
                    cleaned[k] = cut(cleaned[k], m) if clean else None
        hits = [x.count(1) if x else 0 for x in masks]
        out: list[list] = [[len(w) for w in words], hits, [sorted(x) for x in found], longest]
        if clean:
            out.append([c.decode("utf-8", "replace") if n else None for c, n in zip(cleaned, hits, strict=True)])
        return out

    return compute


def drop_contaminated(df: DataFrame, text_col: str = "text", max_coverage: float = 0.5) -> DataFrame:
    """Applies the result of :func:`decontaminate` (with ``clean``): documents whose hit share exceeds
    ``max_coverage`` go, the others keep their text without the hit spans."""
    return df.where(F.col("coverage") <= max_coverage).withColumn(text_col, F.col("clean_text"))
