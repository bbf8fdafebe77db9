"""Column functions for names and quotes. All are built from Spark's own functions unless they say otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic characters and what they stand for when quotes are compared.
SMART_FROM = "‘’“”—–"
SMART_TO = "''\"\"--"
ELLIPSIS = "…"
# Leading articles, and words that a title keeps in lower case.
ARTICLES = ("the", "a", "an")
TITLE_STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "vs", "with")

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: ColumnOrName) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: ColumnOrName) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def norm_for_match(c: ColumnOrName) -> Column:
    """Typographic punctuation in ASCII, hyphen runs and white space folded; letter case stays."""
    folded = F.replace(F.translate(_col(c), SMART_FROM, SMART_TO), F.lit(ELLIPSIS), F.lit("..."))
    return squeeze(F.regexp_replace(folded, "-{2,}", "-"))


def is_verbatim(quote: ColumnOrName, content: ColumnOrName) -> Column:
    """Whether the content holds the quote, both normalised; a blank quote is nowhere."""
    q = norm_for_match(quote)
    return (q != "") & F.contains(norm_for_match(content), q)


def _hyphenate(lowered: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(lowered, r"\s+", "-"), "[^a-z0-9-]", "")
    return F.trim(F.regexp_replace(kept, "-+", "-"), F.lit("-"))


def slug_ascii(c: ColumnOrName) -> Column:
    """Anchor id of a name in ASCII: non-ASCII characters are dropped."""
    return _hyphenate(F.lower(F.regexp_replace(_col(c), r"[^\x00-\x7F]", "")))


@F.pandas_udf(T.StringType())
def _ascii_fold(names: pd.Series) -> pd.Series:
    import unicodedata

    def fold(s):
        if s is None or s.isascii():
            return s
        return "".join(ch for ch in unicodedata.normalize("NFKD", s) if ord(ch) < 128)

    return names.map(fold)


@F.pandas_udf(T.StringType())
def _nfc(names: pd.Series) -> pd.Series:
    import unicodedata

    return names.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


def slug(c: ColumnOrName) -> Column:
    """Anchor id of a name: accents folded (compatibility decomposition, an Arrow function: Spark has none), lower case,
    words joined by hyphens. Empty for a name without ASCII letters or digits."""
    return _hyphenate(F.lower(_ascii_fold(_col(c))))


def name_key(c: ColumnOrName) -> Column:
    """Key under which names count as equal: the slug with spaces."""
    return F.trim(F.replace(slug(c), F.lit("-"), F.lit(" ")))


def name_key_ascii(c: ColumnOrName) -> Column:
    return F.trim(F.replace(slug_ascii(c), F.lit("-"), F.lit(" ")))


@F.pandas_udf(T.StringType())
def _casefold(names: pd.Series) -> pd.Series:
    return names.map(lambda s: s if s is None else s.casefold())


def fold_key(c: ColumnOrName) -> Column:
    """Key of a title or name that is compared without case (full case folding, an Arrow function), "&" as "and"."""
    return squeeze(F.replace(_casefold(F.coalesce(_col(c), F.lit(""))), F.lit("&"), F.lit(" and ")))


def strip_article(key: ColumnOrName) -> Column:
    """A folded key without one leading article."""
    return F.regexp_replace(_col(key), "^(the|a|an) ", "")


def slug_keep_accents(c: ColumnOrName) -> Column:
    """The second slug: composed letters stay, quotes and non-ASCII punctuation go without a hyphen in their place."""
    bare = F.regexp_replace(F.translate(_nfc(_col(c)), "'‘’\"“”", ""), r"[^\x00-\x7F\p{L}\p{N}]", "")
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.lower(bare), r"(?U)[^\w-]+", "-"), F.lit("_"), F.lit("-")), "-+", "-"), F.lit("-"))


def anchor_matches(anchor: ColumnOrName, name: ColumnOrName) -> Column:
    """Whether an anchor is the accent-keeping slug of a name, its leading "the" or a number at the end set aside."""
    bases = F.filter(F.array(slug_keep_accents(name), slug_keep_accents(F.regexp_replace(_col(name), r"(?i)^\s*the\s+", ""))), lambda x: x != "")
    bare = F.regexp_replace(_col(anchor), r"-\d+$", "")
    return F.array_contains(bases, _col(anchor)) | F.array_contains(bases, bare)


def alpha_key(c: ColumnOrName) -> Column:
    """Key that files a name under its first word that is no article."""
    return F.lower(strip_ws(F.regexp_replace(_col(c), r"(?i)^(?:the|a|an)\s+", "")))


def _cap(tok: Column) -> Column:
    return F.array_join(F.transform(F.split(tok, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "-")


def _screaming(tok: Column) -> Column:
    return tok.rlike(r"\p{Lu}") & ~tok.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")


def title_case(c: ColumnOrName) -> Column:
    """Display form of a name: single-case names get capitals, mixed ones only lose all-capital words of four letters."""
    name = _col(c)
    single = name.rlike(r"\p{L}") & ((F.upper(name) == name) | (F.lower(name) == name))
    tokens = F.split(name, " ")
    first = F.size(F.split(F.regexp_extract(name, "^ *", 0), " ")) - 1
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])

    def one(tok: Column, i: Column) -> Column:
        low = F.lower(tok)
        return F.when((i > first) & F.array_contains(stop, low), low).otherwise(_cap(tok))

    full = F.array_join(F.transform(tokens, one), " ")
    letters = lambda t: F.length(F.regexp_replace(t, r"\P{L}", ""))
    loud = F.exists(tokens, lambda t: _screaming(t) & (letters(t) >= 4))
    tamed = F.array_join(F.transform(tokens, lambda t: F.when(_screaming(t), _cap(t)).otherwise(t)), " ")
    return F.when(single & name.rlike("[A-Za-z]{4}"), full).when(loud, tamed).otherwise(name)


def join_details(texts: ColumnOrName) -> Column:
    """Facts as one paragraph, each with a full stop unless it ends with ``.``, ``!`` or ``?``."""
    bare = F.filter(F.transform(_col(texts), strip_ws), lambda t: t != "")
    return F.array_join(F.transform(bare, lambda t: F.when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))), " ")


def clip(c: ColumnOrName, n: int) -> Column:
    """At most ``n`` characters, an ellipsis the last one of a cut text."""
    return F.when(F.length(_col(c)) > n, F.concat(F.left(_col(c), F.lit(n - 1)), F.lit("…"))).otherwise(_col(c))


def code_span(c: ColumnOrName) -> Column:
    """A code span: the fence is one backtick longer than the longest run inside, padded beside a backtick."""
    runs = F.transform(F.regexp_extract_all(_col(c), F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(_col(c).rlike("^`|`$"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, _col(c), pad, fence)


def sentence_shaped(c: ColumnOrName) -> Column:
    """Whether a surface reads like a sentence: end punctuation inside, or more than six words."""
    return _col(c).rlike("[.!?;:]") | (F.size(F.split(F.trim(_col(c)), r"\s+")) > 6)


def phone_key(c: ColumnOrName) -> Column:
    """Digits and plus of a handle with seven digits or more, else null."""
    bare = F.regexp_replace(_col(c), r"[^0-9+]", "")
    return F.when(F.length(F.regexp_replace(bare, r"\D", "")) >= 7, bare)


def recognition(main: ColumnOrName, aliases: ColumnOrName, last: ColumnOrName) -> Column:
    """Lower-cased names a declared party goes by: main name and aliases, alone and with the last name."""
    bases = F.concat(F.array(_col(main)), F.coalesce(_col(aliases), F.expr("array()").cast("array<string>")))
    full = F.when(F.coalesce(_col(last), F.lit("")) != "", F.transform(bases, lambda b: F.concat(b, F.lit(" "), _col(last))))
    every = F.concat(bases, F.coalesce(full, F.expr("array()").cast("array<string>")))
    return F.array_distinct(F.transform(every, lambda x: F.lower(F.trim(x))))


def cache_key(*parts: ColumnOrName) -> Column:
    """SHA-256 of the parts joined by NUL; null counts as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), "\x00"), 256)
