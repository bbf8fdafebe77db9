"""Quality rules with compression bands.

Zstandard's ratio (bytes over compressed bytes) of a whole text and of each of its fixed chunks must stay inside a band
that depends on the length: repetitive text compresses too well, random text not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import add_by_text

SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes: (from this length on, least, most), in ascending order of length.

    Least is 0.9 of the 0.001 quantile and most 1.25 of the 0.999 quantile of the ratios of all 235836 documents of sf0.01,
    sf0.1 and check_l that pass the base rule, at ``level``. Below 256 bytes there are nine of them, so that band is set
    by hand; below 99 bytes no text has 50 words.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 6.0),
        (99, 1.1, 2.2),
        (256, 1.2, 2.43),
        (512, 1.32, 2.67),
        (1024, 1.52, 2.94),
        (2048, 1.68, 3.18),
        (4096, 1.82, 3.36),
        (8192, 1.94, 3.46),
        (16384, 2.04, 3.68),
        (32768, 2.08, 3.69),
        (65536, 2.18, 3.74),
    )
    chunk_bytes: int = 4096
    #: Set like ``whole``, from 151048 chunks.
    chunk: tuple[float, float] = (1.77, 3.28)
    #: A text fails if a larger share of its bytes lies in chunks outside the chunk band.
    max_bad_chunks: float = 0.2
    #: A text fails if so many bytes on end, in chunks, lie in chunks outside the chunk band.
    max_bad_run: int = 2
    level: int = 3


def word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words of a text: equal words, equal numbers."""
    put = seen.setdefault
    return np.fromiter((put(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words in ``size``-word windows that stand twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = word_hashes(words, {})
    base = int(ids.max()) + 1
    keys = ids[:n].copy()
    for k in range(1, size):
        if base ** (k + 1) >= 2**62:  # number the keys anew so that they stay exact
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * base + ids[k : n + k]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(size):
        covered[k : n + k] |= twice
    return int(covered.sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = raw.split()
    spaces = sum(raw.count(c.encode()) for c in _SPACES)
    chars = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars - spaces, symbols, len(lines) - len(set(lines)), repeat_words(words)


def bad_chunks(raw: bytes, zstd: zstandard.ZstdCompressor, bands: Bands) -> tuple[int, int]:
    """Bytes in chunks outside the chunk band, and the longest stretch of them.

    The chunks stand side by side from the start; if bytes are left, a last full chunk ends with the text. So every byte
    of a text with one chunk or more is judged; shorter texts have the whole band alone.
    """
    size = bands.chunk_bytes
    starts = list(range(0, len(raw) - size + 1, size))
    if starts and len(raw) % size:
        starts.append(len(raw) - size)
    bad = longest = run = end = 0  # ``end``: where the bad bytes so far end
    for k in starts:
        if bands.chunk[0] <= size / len(zstd.compress(raw[k : k + size])) <= bands.chunk[1]:
            continue
        new = k + size - max(k, end)
        run = run + new if k <= end else new
        bad, end = bad + new, k + size
        longest = max(longest, run)
    return bad, longest


def compression(raw: bytes, zstd: zstandard.ZstdCompressor, bands: Bands) -> tuple[float | None, float, bool]:
    """Ratio of the whole text (None if it is empty), share of bytes in chunks outside their band, and the verdict."""
    if not raw:
        return None, 0.0, True
    ratio = len(raw) / len(zstd.compress(raw))
    least, most = [(a, b) for n, a, b in bands.whole if n <= len(raw)][-1]
    bad, longest = bad_chunks(raw, zstd, bands)
    share = bad / len(raw)
    fits = share <= bands.max_bad_chunks and longest < bands.max_bad_run * bands.chunk_bytes
    return ratio, share, least <= ratio <= most and fits


_FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("word_chars", T.LongType(), False),
    T.StructField("n_symbols", T.LongType(), False),
    T.StructField("n_dup_lines", T.LongType(), False),
    T.StructField("n_repeat_words", T.LongType(), False),
    T.StructField("zstd_ratio", T.DoubleType()),
    T.StructField("bad_chunk_share", T.DoubleType(), False),
    T.StructField("in_bands", T.BooleanType(), False),
]


def _factory(bands: Bands) -> Callable:
    zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)

    def compute(texts: list[bytes | None]) -> list[list]:
        rows = [(*base_counts(x or b""), *compression(x or b"", zstd, bands)) for x in texts]
        return list(map(list, zip(*rows, strict=True)))

    return compute


def quality_rules(df: DataFrame, text_col: str = "text", bands: Bands = Bands(), keep: list[str] | None = None) -> DataFrame:
    r"""Adds the counts and verdicts of the rules to each row; no shuffle.

    New columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``zstd_ratio``,
    ``bad_chunk_share``, ``in_bands``, ``base_failed`` (under 50 words, or over half of them in repeated windows) and
    ``kept`` (not base_failed and in_bands). A null or empty text has zeros, a null ratio and fails the base rule.
    Every text is compressed whole, however long. Repeated rows get equal results. Input columns with the name of a
    new one are replaced. ``keep``: the input columns to return besides (all by default).
    """
    out = add_by_text(df, text_col, partial(_factory, bands), _FIELDS, keep=keep)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("in_bands"))
