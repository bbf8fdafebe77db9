"""Byte-level BPE encoding with a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if the merges leave every pair of neighbours as it is.
So encoding is a nondeterministic finite-state transducer: it walks a trie of the tokens, and where a token ends that
may follow the last one, it may emit it and start anew. Determinising it gives states that are sets of such hypotheses:
the last token and the place in the trie. States and transitions are only made when a text reaches them.

A prefix has one encoding, so in every state one hypothesis at most stands at the trie's root; its last token is the
state's output, the token that ends here if a token does. What all hypotheses trace back to is certain: it is emitted
after a bounded lookahead, and the rest at the end.

Decoding joins token bytes through a state machine of UTF-8 that holds back an unfinished character.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeinwork.llm.common import add_by_text, resident

#: Bounds of what a worker keeps: states of the transducer, pairs and merges of tokens, and bytes of chunks with their ids.
MAX_STATES, MAX_PAIRS, MAX_PARTS, MAX_CHUNK_BYTES = 80_000, 100_000, 10_000, 8 << 20
#: Bytes after which what is certain by then is emitted.
LOOKAHEAD = 1 << 10
#: Tokens that are decoded at once.
DECODE_AT_ONCE = 1 << 12
#: A vocabulary beyond so many bytes is refused: it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
_NONE = 1 << 60
#: A hypothesis is one number: the last token above these bits, the trie's node in them.
_SHIFT = 24
_NODE = (1 << _SHIFT) - 1
#: Fixed value: the public pattern for which texts may be cut at single spaces; others are matched over whole texts.
SPACE_PREFIX_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} holds more than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class State(dict):
    """A state of the determinised transducer: its hypotheses, its output, and the next state by byte as far as known."""

    __slots__ = ("machine", "members", "output")

    def __init__(self, machine: Transducer, members: tuple[int, ...], output: int) -> None:
        self.machine, self.members, self.output = machine, members, output

    def __missing__(self, byte: int) -> State:
        return self.machine.next(self, byte)


class Transducer:
    """Encodes byte strings by ``ranks``."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.depth, self.inner = array("H", [0]), {0}
        for token, rank in ranks.items():
            at = 0
            for b in token:
                to = self.child.get(at << 8 | b)
                if to is None:
                    to = self.child[at << 8 | b] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                    self.inner.add(at)
                at = to
            self.token_at[at] = rank
        self.size_of = {r: len(t) for r, t in self.bytes_of.items()}
        self.parts: dict[int, tuple[list, list, bool] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, ...], State] = {}
        self.first = State(self, (0,), -1)  # no last token, at the root

    def next(self, state: State, byte: int) -> State:
        """The state after ``byte``, made on the first visit; beyond ``max_states`` new ones are not kept."""
        members, output = self._move(state.members, byte)
        to = self.states.get(members)
        if to is None:
            to = State(self, members, output)
            if len(self.states) >= self.max_states:
                return to
            self.states[members] = to
        state[byte] = to
        return to

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """The merges applied to a short string, lowest rank first: what compiles tokens and pairs."""
        get = self.ranks.get
        while len(parts) > 1:
            ranks = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
            rank = min(ranks)
            if rank == _NONE:
                break
            k = ranks.index(rank)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _spines(self, token: int) -> tuple[list, list, bool] | None:
        """What stands at the left and at the right end of a token while it is merged, each with its rank and that of
        the merge that ends it, and whether the ranks of its merges only rise; None if merges don't make the token."""
        if token not in self.parts:
            if len(self.parts) >= MAX_PARTS:
                self.parts.clear()
            ranks, raw = self.ranks, self.bytes_of[token]
            parts = [raw[k : k + 1] for k in range(len(raw))]
            left, right, order = [parts[0]], [parts[-1]], []
            while len(parts) > 1:
                near = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
                rank = min(near)
                if rank == _NONE:
                    break
                k = near.index(rank)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                order.append(rank)
                if k == 0:
                    left.append(parts[0])
                if k == len(parts) - 1:
                    right.append(parts[-1])
            timed = [[(x, ranks[x], ranks[y] if y else _NONE) for x, y in zip(side, [*side[1:], b""], strict=True)] for side in (left, right)]
            self.parts[token] = (*timed, order == sorted(order)) if len(parts) == 1 else None
        return self.parts[token]

    def _follows(self, last: int, token: int) -> bool:
        """Whether the merges leave ``last`` and ``token`` as they are when one follows the other."""
        if last < 0:
            return self._spines(token) is not None
        known = self.pairs.get(last << 32 | token)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[last << 32 | token] = self._compatible(last, token)
        return known

    def _compatible(self, last: int, token: int) -> bool:
        after = self._spines(token)
        if after is None:
            return False
        before, get, plain = self._spines(last), self.ranks.get, after[2]
        plain = plain and before[2]
        # Until a merge crosses the border, what stands beside it is of these two spines. A crossing merge comes about
        # if its rank is below that of the merge that ends its left part, and not above that of its right part.
        for x, rank_x, end_x in before[1]:
            for y, rank_y, end_y in after[0]:
                rank = get(x + y)
                if rank is not None:
                    if not plain or rank < rank_x or rank < rank_y:  # ranks that fall back: apply the merges themselves
                        raw = self.bytes_of[last] + self.bytes_of[token]
                        return self.merged([raw[k : k + 1] for k in range(len(raw))]) == [self.bytes_of[last], self.bytes_of[token]]
                    if rank < end_x and rank <= end_y:
                        return False
        return True

    def _move(self, members: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        """One step of the subset construction: the next hypotheses, and the token that ends here (-1: none does).

        A hypothesis is the number of its last token plus one, shifted, and its node. A node without children is left
        out: only the token that ends there went on from it.
        """
        made, output = [], -1
        for x in members:
            last, node = x >> _SHIFT, x & _NODE
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            if to in self.inner:
                made.append(last << _SHIFT | to)
            if output < 0:
                token = self.token_at.get(to)
                if token is not None and self._follows(last - 1, token):
                    output = token
        if output >= 0:
            made.append((output + 1) << _SHIFT)
        elif not made:
            raise ValueError(f"no token covers byte {byte}")
        made.sort()
        return tuple(made), output

    def _settled(self, path: list[State]) -> int:
        """How many of the bytes read are covered by tokens that all hypotheses share. ``path``: the state after each."""
        size_of, depth = self.size_of, self.depth
        starts = {len(path) - depth[x & _NODE] for x in path[-1].members}
        while len(starts) > 1:
            k = max(starts)
            starts.remove(k)
            starts.add(k - size_of[path[k - 1].output])
        return starts.pop()

    def _traced(self, path: list[State], k: int) -> list[int]:
        """The tokens of the first ``k`` bytes."""
        size_of, out = self.size_of, []
        while k:
            token = path[k - 1].output
            out.append(token)
            k -= size_of[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of a piece; a piece that is a token itself is that token.

        Known states move by table. Once ``max_states`` are kept, the hypotheses of further ones are only carried along.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, path = self.first, [], []
        put = path.append
        for lo in range(0, len(piece), LOOKAHEAD):
            for b in piece[lo : lo + LOOKAHEAD]:
                state = state[b]
                put(state)
            if lo + LOOKAHEAD < len(piece):
                k = self._settled(path)
                out += self._traced(path, k)
                del path[:k]
        if path and path[-1].output < 0:
            raise ValueError("the vocabulary lacks single bytes")
        return out + self._traced(path, len(path))


class StreamDecoder:
    """Ids to text, a chunk at a time: the incremental UTF-8 machine holds back the bytes of an unfinished character."""

    def __init__(self, tokens: list[bytes], errors: str = "replace") -> None:
        self.tokens, self.machine = tokens, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: list[int]) -> str:
        """The characters that are finished by now."""
        return self.machine.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def end(self) -> str:
        """What is left of an unfinished character."""
        return self.machine.decode(b"", True)


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """Token bytes by id."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class _Chunks(dict):
    """Packed ids of chunks met before; a new one is encoded on the way. Of two generations of ``limit`` bytes each the
    older one goes when the younger is full, so that frequent chunks stay. Long chunks are not kept."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = MAX_CHUNK_BYTES) -> None:
        super().__init__()
        self.encode, self.older, self.limit, self.held = encode, {}, limit, 0

    def __missing__(self, chunk: str) -> bytes:
        packed = self.older.get(chunk)
        if packed is None:
            packed = self.encode(chunk)
        size = _ENTRY_BYTES + len(chunk) + len(packed)
        if size <= self.limit >> 8:
            if self.held + size > self.limit:
                self.older, self.held = dict(self), 0
                self.clear()
            self[chunk] = packed
            self.held += size
        return packed


#: Bytes that an entry of a store takes besides its texts, about.
_ENTRY_BYTES = 160


class Codec:
    """A pattern, a transducer and a decoder with a bounded store of chunks met before.

    No match of the pattern goes on over a single space between two other characters: the space starts the next one. A
    single line end between two others is a match of its own. So a text where all white space is of that kind is cut
    there, and only chunks not met before are matched.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.tokens = token_table(ranks)
        self.pieces, self.inner = _Chunks(self._piece), _Chunks(self._inner, 2 * MAX_CHUNK_BYTES)
        self.cut_at_spaces = pattern == SPACE_PREFIX_PATTERN
        self.line_end = self._piece("\n") if self.cut_at_spaces else b""

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _inner(self, chunk: str) -> bytes:
        """A chunk and the space before it: letters alone are one match, so are letters before a mark."""
        if chunk.isalpha():
            return self._piece(" " + chunk)
        if chunk[-1] in _MARKS and chunk[:-1].isalpha():
            return self.inner[chunk[:-1]] + self.pieces[chunk[-1]]
        return self._pieces(" " + chunk)

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cut_at_spaces or not text:
            return self._pieces(text)
        if text[0].isspace() or text[-1].isspace() or _NOT_CUT(text):
            return b"".join(self._runs(text.split(" ")))
        inner = self.inner.__getitem__
        lines = []
        for line in text.split("\n"):
            chunks = line.split(" ")
            lines.append(self._pieces(chunks[0]) + b"".join(map(inner, chunks[1:])))
        return self.line_end.join(lines)

    def _runs(self, chunks: list[str]) -> Iterable[bytes]:
        """As above where some spaces stand beside other white space: those are not cut at."""
        run, spaced = [chunks[0]], False
        for chunk in chunks[1:]:
            if run[-1] and chunk and not run[-1][-1].isspace() and not chunk[0].isspace():
                yield self._run(run, spaced)
                run, spaced = [chunk], True
            else:
                run.append(chunk)
        yield self._run(run, spaced)

    def _run(self, run: list[str], spaced: bool) -> bytes:
        if len(run) > 1 or not spaced:
            return self._pieces(" " * spaced + " ".join(run))
        return self.inner[run[0]]

    def decode(self, packed: bytes) -> Iterable[str]:
        """The text in parts, as a stream of ids gives it."""
        one, ids = StreamDecoder(self.tokens), np.frombuffer(packed, dtype="<u4")
        for k in range(0, len(ids), DECODE_AT_ONCE):
            yield one.feed(ids[k : k + DECODE_AT_ONCE].tolist())
        yield one.end()


_MARKS = ",.;:!?"
#: Finds two white-space characters in a row, of which one may be a space that the pattern does not cut at.
_NOT_CUT = re.compile(r"\s\s").search


class _Shared:
    """A broadcast with its content's digest, under which a reused worker keeps its codec."""

    def __init__(self, broadcast, key: str) -> None:
        self.broadcast, self.key = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def _factory(ranks: _Shared, pattern: str, with_ids: bool) -> Callable:
    codec = resident(("bpe", ranks.key, pattern), lambda: Codec(ranks.value, pattern))

    def compute(texts: list[bytes | None]) -> list[list]:
        n, digests, decoded, ids = [], [], [], []
        for raw in texts:
            packed = codec.encode((raw or b"").decode("utf-8", "replace"))
            n.append(len(packed) // 4)
            digests.append(hashlib.sha256(packed).hexdigest())
            digest = hashlib.sha256()
            for part in codec.decode(packed):
                digest.update(part.encode("utf-8"))
            decoded.append(digest.hexdigest())
            if with_ids:
                ids.append(np.frombuffer(packed, dtype="<u4").astype(np.int32))
        return [n, digests, decoded, *([ids] if with_ids else [])]

    return compute


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` (over ids as little-endian unsigned 32-bit integers), ``decoded_sha256`` (over
    the bytes decoded from the ids) and, ``with_ids``, ``token_ids``; no shuffle.

    A null text is an empty one: no tokens, the digests of nothing. Strings of special tokens are ordinary text. Every
    text is encoded whole. Repeated rows get equal results. Input columns with the name of a new one are replaced.
    ``keep``: the input columns to return besides (all by default); texts that are not wanted back are not sent back.
    """
    ranks = load_ranks(ranks_path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = _Shared(df.sparkSession.sparkContext.broadcast(ranks), key)
    fields = [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ]
    if with_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType()), False))
    return add_by_text(df, text_col, partial(_factory, shared, pattern, with_ids), fields, keep=keep)
