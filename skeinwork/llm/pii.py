"""Personal data: expressions propose spans, checks confirm them, nearby words adjust the score.

DataFrame functions only. Positions come from splitting a text at an expression's matches: the lengths of the parts
between and of the matches add up to them. Sums over long lists go by blocks, so a text with many matches stays linear
in most of the work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 128
#: Code points on either side of a match in which context words count.
CONTEXT = 40
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``hint`` is a string that every match holds (empty: none is known)."""

    name: str
    regex: str
    valid: Callable[[Column], Column]
    context: str
    base_score: float
    least_score: float
    hint: str = ""


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip(m: Column) -> Column:
    def part(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(F.length(bare) <= 3, bare).otherwise(F.lit("999")).cast("int") <= 255

    return F.forall(F.split(m, r"\."), part)


def _card(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def _iban(m: Column) -> Column:
    """Mod-97 of the letters and digits with the first four moved to the end, a letter counting as 10 to 35."""
    bare = F.translate(m, " ", "")
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.length(bare).between(15, 34) & (rest == 1)


def _iban_regex() -> str:
    """As long as its country's are, so that words in capitals after it stay out; other countries' as long as can be."""
    known = "|".join(c for names in IBAN_LENGTHS.values() for c in names.split())
    by_length = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{by_length}|(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"


# A match may start after a character of its own class only where the last match ended. The possessive forms match what
# the plain ones do and neither back up nor recurse, so that long runs stay linear and need no stack.
_LOCAL = "[A-Za-z0-9._%+-]"
#: In the order in which spans with an equal start are listed.
BASE_KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "mail|contact|write", 0.8, 0.0, "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, r"\bip\b|address|host|server", 0.6, 0.0, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, "card|visa|credit|payment", 0.7, 0.0),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, "phone|call|tel|mobile|fax", 0.6, 0.0, "+"),
)
MORE_KINDS = (
    Kind("iban", _iban_regex(), _iban, "iban|account|bank|konto|compte|cuenta", 0.7, 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: F.lit(True), r"ssn|social|security", 0.3, 0.5, "-"),
)
CONTEXT_BOOST = 0.25


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``op`` (0 is neutral for it) over an array of longs, in blocks."""
    n, zero = F.size(values), F.lit(0).cast("bigint")
    blocks = F.when(n == 0, F.expr("array()").cast("array<array<bigint>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda k: F.slice(values, k * _BLOCK + 1, _BLOCK))
    )

    def push(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(op(F.element_at(acc, -1), x)))

    offsets = F.aggregate(blocks, F.array(zero), lambda acc, b: push(acc, F.aggregate(b, zero, op)))
    runs = F.zip_with(
        blocks,
        F.slice(offsets, F.lit(1), F.size(blocks)),
        lambda b, o: F.slice(F.aggregate(b, F.array(o), push), F.lit(2), F.size(b)),
    )
    return F.when(n == 0, F.expr("array()").cast("array<bigint>")).otherwise(F.flatten(runs))


def _ends(steps: Column) -> Column:
    return _running(steps, lambda s, x: s + x)


def _confirmed(matches: Column, kind: Kind, n: int) -> Column:
    """Spans of the matches (gap before, match, gap after, end) that pass the check and reach the least score."""

    def span(x: Column) -> Column:
        near = F.lower(F.right(x["g"], F.lit(CONTEXT))).rlike(kind.context) | F.lower(F.left(x["h"], F.lit(CONTEXT))).rlike(kind.context)
        score = F.least(F.lit(1.0), F.lit(kind.base_score) + F.when(near, F.lit(CONTEXT_BOOST)).otherwise(F.lit(0.0)))
        start = x["e"] - F.length(x["m"])
        return F.struct(start.alias("start"), F.lit(n).alias("ord"), x["e"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    spans = F.transform(F.filter(matches, lambda x: kind.valid(x["m"])), span)
    return F.filter(spans, lambda s: s["score"] >= kind.least_score) if kind.least_score > 0 else spans


_SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string,score:double>>"


def find_spans(df: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = BASE_KINDS + MORE_KINDS) -> DataFrame:
    """Adds ``pii_spans``: an array of (start, ord, end, kind, score) in code points, the end exclusive, sorted by
    start and then by the order of ``kinds``.

    Per kind, matches are leftmost and do not overlap; one that its check rejects is dropped without another try.
    Spans of different kinds may overlap. The score is the kind's base score, plus ``CONTEXT_BOOST`` where one of its
    context words stands in the ``CONTEXT`` code points before (not reaching into the match before), 1 at most; spans
    below the kind's least score are dropped (never for base kinds). A null or empty text has no spans. Texts are read
    whole, nothing is shuffled. An input column of that name is replaced.
    """
    out = df.drop("pii_spans").withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    none = F.expr("array()")
    for n, kind in enumerate(kinds):
        here = F.contains("__t", F.lit(kind.hint)) if kind.hint else F.lit(True)
        out = out.withColumn(f"__m{n}", F.when(here, F.regexp_extract_all("__t", F.lit(kind.regex), F.lit(0))).otherwise(none.cast("array<string>")))
        some = F.size(f"__m{n}") > 0
        out = out.withColumn(f"__g{n}", F.when(some, F.split("__t", kind.regex, -1)).otherwise(none.cast("array<string>")))
        gaps = F.slice(F.col(f"__g{n}"), F.lit(1), F.size(f"__m{n}"))
        out = out.withColumn(f"__s{n}", F.zip_with(gaps, F.col(f"__m{n}"), lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
        out = out.withColumn(f"__e{n}", F.when(some, _ends(F.col(f"__s{n}"))).otherwise(none.cast("array<bigint>")))

        after = F.slice(F.col(f"__g{n}"), F.lit(2), F.size(f"__m{n}"))
        both = F.arrays_zip(F.slice(F.col(f"__g{n}"), F.lit(1), F.size(f"__m{n}")).alias("g"), F.col(f"__m{n}").alias("m"), after.alias("h"), F.col(f"__e{n}").alias("e"))
        found = _confirmed(both, kind, n)
        out = out.withColumn(f"__f{n}", F.when(some, found).otherwise(none.cast(_SPAN)))
    spans = F.array_sort(F.concat(*[F.col(f"__f{n}") for n in range(len(kinds))]))
    return out.withColumn("pii_spans", spans).drop("__t", *[f"__{c}{n}" for c in "mgsef" for n in range(len(kinds))])


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("bigint")


#: Code points of a text that are looked up together when it is taken apart.
_PAGE = 4096


def redact(df: DataFrame, text_col: str = "text", placeholder: str = "<PII>") -> DataFrame:
    """The text with each stretch that ``pii_spans`` cover replaced by ``placeholder``; a null text stays null.

    Spans that overlap make one stretch. The text is taken apart by pages, so the work follows its length plus the
    number of spans.
    """
    text = F.col(text_col)
    out = df.withColumn("__to", _running(F.transform("pii_spans", lambda s: s["end"]), lambda m, x: F.greatest(m, x)))
    out = out.withColumn("__pages", F.when(F.size("pii_spans") > 0, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PAGE}}}"), F.lit(0))))

    def between(lo: Column, hi: Column) -> Column:
        first, last = F.floor(lo / _PAGE).cast("int"), F.floor(F.greatest(hi - 1, lo) / _PAGE).cast("int")
        joined_pages = F.array_join(F.slice(F.col("__pages"), first + 1, last - first + 1), "")
        return F.substring(joined_pages, (lo - first * _PAGE + 1).cast("int"), (hi - lo).cast("int"))

    def part(s: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("__to"), k - 1))
        return F.when(s["start"] >= before, F.concat(between(before, s["start"]), F.lit(placeholder))).otherwise(F.lit(""))

    cleaned = F.concat(F.array_join(F.transform("pii_spans", part), ""), between(F.element_at("__to", -1), F.length(text).cast("bigint")))
    return out.withColumn(text_col, F.when(F.size("pii_spans") > 0, cleaned).otherwise(text)).drop("__to", "__pages")
