"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table, a parameter; ``TRAINING`` is the default one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import add_by_text

DIM = 1 << 16
SIZES = (3, 4, 5)
#: A labelled table beyond so many rows is refused: it is read into the driver.
MAX_TRAIN_ROWS = 20_000

# The rules of the production query as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# A labelled URL table, 1 for URLs to block.
TRAINING = tuple(
    [(f"https://{u}", 0) for u in (
        "en.wikipedia.org/wiki/Linguistics", "www.gutenberg.org/ebooks/1342", "docs.python.org/3/library/re.html", "arxiv.org/abs/1706.03762",
        "www.nature.com/articles/paper.html", "news.example.org/world/2023/05/12345", "blog.example.net/en/2021/notes.html", "www.city-library.org/catalogue/4711",
        "example.org/about", "www.university.edu/research/groups/physics", "forum.example.com/en/12345", "m.example.net/de/2231.html",
        "shop.bookstore.com/item/4411?ref=home", "www.museum.fr/fr/expositions/1200", "www.zeitung.de/politik/artikel-88123.html", "periodico.es/cultura/2020/99812",
        "recipes.example.org/en/soup/1021/", "weather.gov/forecast/zone/12", "www.parliament.uk/business/papers", "github.com/project/readme",
        "stackoverflow.com/questions/11227809", "www.hospital.org/patients/visit", "travel.example.com/fr/guide/301", "www.school.org/teachers/maths",
        "history.example.net/es/archive/7712", "garden.example.org/en/5531.html", "www.orchestra.org/concerts/2024", "podcast.example.com/episode/88",
        "maps.example.org/de/city/99", "openscience.example.net/en/data/4410/", "www.example.com/fr/11002", "journal.example.org/en/33290",
        "farm.example.org/en/milk/221", "www.cheese-maker.fr/fr/produits", "bank.example.com/en/contact", "games.example.org/en/chess/opening",
    )]
    + [(f"http://{u}", 1) for u in (
        "www.spam-farm.biz/en/1001", "spam-farm.example.org/de/20", "spamfarm.info/offer", "cheap-spam.top/mail/list", "www.spam-links.xyz/en/33", "best-casino-bonus.xyz/free-spins",
        "online-casino.top/slots/win", "www.casino-royal.bet/jackpot", "poker-bonus.win/play-now", "xxx-videos.example.net/hot/1", "www.porn-tube.xxx/watch/99", "adult-cams.top/live/xxx",
        "free-porn.example.org/en/22", "cheap-viagra.biz/buy-now", "pills-online.top/viagra/cialis", "buy-cialis.example.net/pharmacy", "replica-watches.shop/rolex-cheap", "fake-bags.store/discount/outlet",
        "click-here-win.top/prize/claim", "you-won-prize.xyz/claim-now", "free-iphone.click/winner", "crypto-doubler.top/invest-now", "payday-loans.biz/fast-cash", "quick-loan-cash.xyz/apply",
        "malware-download.top/crack/keygen.exe", "warez-crack.net/serial/keygen", "torrent-crack.xyz/full-download", "seo-backlinks.top/buy-links", "link-farm.example.com/en/links", "www.link-farm.biz/page/1",
        "doorway-pages.top/keyword/77", "phishing-login.xyz/verify-account", "secure-verify.top/paypal-login", "hot-singles.date/near-you", "sports-bets.top/free-bets/odds", "live-betting.win/free-bet", "escort-girls.xyz/city", "www.junk-mail.top/list",
    )]
)


def ngrams(host: str, path: str) -> np.ndarray:
    """Distinct dimensions of the character n-grams of host and path; the two have n-grams of their own."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"{path}$")):
        for size in SIZES:
            for k in range(len(part) - size + 1):
                found.add(zlib.crc32(f"{mark}{part[k : k + size]}".encode("utf-8", "replace")) % DIM)
    return np.fromiter(found, dtype=np.int64, count=len(found))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the query defines them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:k].translate({c: c + 32 for c in range(65, 91)})
    path = rest[k:]
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, dims: np.ndarray) -> float:
        if not len(dims):  # neither host nor path: nothing speaks against it
            return 0.0
        x = float(self.weights[dims].sum()) / max(1.0, np.sqrt(len(dims))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


#: Every labelled URL counts with these before its host too: they say nothing about a site.
PREFIXES = ("www.", "m.", "blog.")


def train(rows=TRAINING, epochs: int = 300, rate: float = 2.0, l2: float = 1e-3) -> UrlModel:
    """Gradient descent on the log loss; classes weigh the same in sum. Null URLs or labels are left out; without both
    classes the model scores everything 0 or, with blocked URLs alone, 1."""
    rows = [(u, int(y)) for u, y in rows if u is not None and y is not None]
    if len(rows) > MAX_TRAIN_ROWS:
        raise ValueError(f"the labelled URL table holds more than {MAX_TRAIN_ROWS} rows")
    y = np.array([y > 0 for _, y in rows], dtype=float)
    if not rows or y.min() == y.max():
        return UrlModel(np.zeros(DIM), 40.0 if rows and y[0] else -40.0)
    places = [(split_url(u), label) for u, label in rows]
    places = [((p + h, path), label) for (h, path), label in places for p in ("", *PREFIXES)]
    y = np.array([label > 0 for _, label in places], dtype=float)
    dims = [ngrams(*place) for place, _ in places]
    values = np.concatenate([np.full(len(d), 1 / max(1.0, np.sqrt(len(d)))) for d in dims])
    owner = np.repeat(np.arange(len(dims)), [len(d) for d in dims])
    flat = np.concatenate(dims)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(DIM), 0.0
    for _ in range(epochs):
        margin = np.bincount(owner, w[flat] * values, minlength=len(dims)) + b
        g = (1 / (1 + np.exp(-margin)) - y) * weight
        w -= rate * (np.bincount(flat, g[owner] * values, minlength=DIM) + l2 * w)
        b -= rate * g.sum()
    return UrlModel(w, float(b))


def _factory(model) -> Callable:
    fitted = model.value

    def compute(texts: list[bytes | None]) -> list[list]:
        pairs = (x.decode("utf-8", "replace").split("\n", 1) for x in texts)
        return [[fitted.score(ngrams(h, p)) for h, p in pairs]]

    return compute


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``block_score`` and ``verdict`` ("allow" or "block") to each row; no shuffle.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. A null URL or one without ``://`` has both empty and
    is allowed. A rule fits its host and that host's subdomains
    where the path starts with the rule's; the longest (host and path) wins, the earlier one of equal rules. Without a
    rule, the model blocks from ``threshold`` on. Repeated rows get equal results; input columns with the name of a new
    one are replaced.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = pages.withColumns(
        {
            "__host": F.translate(F.regexp_extract(url, shape, 1), upper, upper.lower()),
            "__path": F.regexp_extract(url, shape, 2),
        }
    )
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("__host") == host) | F.endswith("__host", F.lit(f".{host}"))) & F.startswith("__path", F.lit(path))
        rule = F.when(fits, f"{host}{path}") if rule is None else rule.when(fits, f"{host}{path}")
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    nothing = F.lit(None).cast("string")
    out = out.withColumns({"__rule": nothing if rule is None else rule, "__kind": nothing if verdict is None else verdict})
    # A line break would part host from path wrongly; a URL's own ones go.
    both = F.concat_ws("\n", F.translate("__host", "\n", ""), F.translate("__path", "\n", ""))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    out = add_by_text(out.withColumn("__both", both), "__both", partial(_factory, shared), [T.StructField("block_score", T.DoubleType(), False)])
    made = {
        "host": F.col("__host"),
        "path": F.col("__path"),
        "rule": F.col("__rule"),
        "verdict": F.coalesce("__kind", F.when(F.col("block_score") >= threshold, "block").otherwise("allow")),
    }
    return out.withColumns(made).drop("__host", "__path", "__rule", "__kind", "__both")
