"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .batches import map_batches

#: host, path, verdict
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

# Words that a curator blocks in names of hosts, by kind, and words of harmless names.
BLOCKED_WORDS = (
    "casino poker jackpot roulette blackjack lottery betting sportsbook slots bingo gambling wager "
    "viagra cialis pharmacy pills tramadol steroids slimming dietpills painkiller "
    "porn xxx sex nude escort webcam erotic hentai adult camgirls milf fetish "
    "payday loans quickcash forex bitcoin-doubler getrich moneymaker debtrelief creditfix "
    "warez crack keygen torrent malware trojan phishing botnet hacktool "
    "adserver popunder clickfraud tracker spyware backlinks linkexchange spam replica counterfeit fakeid rolex"
).split()
HARMLESS_WORDS = (
    "library museum weather garden science history music books university travel recipes health school river mountain "
    "archive theatre station kitchen language chemistry physics biology poetry painting orchestra football cycling hiking "
    "climate energy transport railway airport harbour council parliament ministry hospital clinic dentist bakery market "
    "furniture textile pottery software database compiler network keyboard camera telescope planet astronomy geology "
    "fishing sailing village castle cathedral bridge forest meadow orchard vineyard farm horse sheep honey cheese bread "
    "coffee tea lawyer justice election economy finance insurance bank journal magazine radio podcast cinema festival "
    "children parents teacher student academy college grammar dictionary encyclopedia atlas calendar notebook workshop "
    "carpenter plumber electric solar window roof paint tools bicycle walking running swimming chess puzzle lantern"
).split()
_HEADS = ("", "my", "the-", "best-", "new-", "city-")
_TAILS = ("", "hub", "-online", "24", "-club", "zone", "-world", "direct", "s4u", "-house")
_SYLLABLES = "ba be bo ca co da de di do fa fe fi ga ge ha he hi jo ka ki la le li lo ma me mi mo na ne no or pa pe ra re ri ro sa se si ta te ti to va ve vi wa we yo".split()
_PATHS = {
    True: ("/", "/{lang}/{n}", "/promo/{n}", "/{lang}/join?ref={n}", "/offers/{word}-{n}.html", "/go.php?id={n}"),
    False: ("/", "/{lang}/{n}", "/news/{n}/{word}.html", "/{lang}/about?p={n}", "/articles/{word}-{n}.html", "/search.php?q={n}"),
}


def labelled_names() -> list[tuple[str, str, bool]]:
    """host name, the word in it, blocked: every word with some heads and tails in turn, and as many harmless
    names made of syllables, which mean nothing, as names of harmless words."""
    out = []
    for words, blocked, each in ((BLOCKED_WORDS, True, 4), (HARMLESS_WORDS, False, 2)):
        for i, word in enumerate(words):
            for j in range(each):
                k = each * i + j
                out.append((_HEADS[k * 7 % len(_HEADS)] + word + _TAILS[k * 3 % len(_TAILS)], word, blocked))
    n = len(_SYLLABLES)
    for k in range(2 * len(HARMLESS_WORDS)):
        word = "".join(_SYLLABLES[(k * (17 + 12 * j) + 5 * j) % n] for j in range(2 + k % 3))
        out.append((_HEADS[k % len(_HEADS)] + word + _TAILS[k * 3 % len(_TAILS)], word, False))
    return out


def labelled_urls(names: list[tuple[str, str, bool]] | None = None) -> list[tuple[str, bool]]:
    """Whole urls with paths, a few for each name, and whether they are blocked: a small table made by rule from
    the words above, without regard to any table of pages."""
    out = []
    for k, (name, word, blocked) in enumerate(labelled_names() if names is None else names):
        for j in range(3):
            path = _PATHS[blocked][(k + 2 * j) % 6 if j else 1].format(lang="en de fr es".split()[(k + j) % 4], n=(k * 37 + j * 11) % 997, word=word)
            prefix = ("", "www.", "m.", "blog.")[(k + j) % 4]
            domain = ("com", "net", "org", "info", "example.com", "example.net", "example.org")[(k * 3 + j) % 7]
            out.append((f"https://{prefix}{name}.{domain}{path}", blocked))
    return out


BITS = 13
ORDERS = (3, 4)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; '' for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host + path, and its verdict; null without one."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


class Model:
    """Logistic regression; the features of a url are shares of its host-and-path n-grams."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, host: str, path: str) -> float:
        """Probability of block; 0 for an empty host."""
        if not host:
            return 0.0
        slots = ngrams.hashed(f"^{host}{path}$", BITS, ORDERS)
        s = float(self.weights[slots].sum()) / np.sqrt(max(1, len(slots))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


@functools.cache
def fitted() -> "Model":
    return fit(labelled_urls())


def fit(labelled: Sequence[tuple[str, bool]], steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> Model:
    """Gradient descent with momentum over a labelled table of at most some thousand urls, in order of the table."""
    x, y = np.zeros((len(labelled), 1 << BITS), dtype=np.float32), np.array([b for _, b in labelled], dtype=np.float32)
    for i, (url, _) in enumerate(labelled):
        host, _, rest = url.partition("://")[2].partition("/")
        slots = ngrams.hashed(f"^{host.lower()}/{rest.partition('?')[0].partition('#')[0]}$", BITS, ORDERS)
        np.add.at(x[i], slots, 1 / np.sqrt(max(1, len(slots))))
    w, b = np.zeros(1 << BITS, dtype=np.float32), 0.0
    step_w, step_b = w, b
    for _ in range(steps):
        g = ((1 / (1 + np.exp(-(x @ w + b))) - y) / max(1, len(y))).astype(np.float32)
        step_w, step_b = 0.95 * step_w - rate * (x.T @ g + decay * w), 0.95 * step_b - rate * g.sum()
        w, b = w + step_w, b + step_b
    return Model(w, b)


def judge_urls(pages: DataFrame, rules=RULES, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; only page_id and url are read.

    The longest rule that fits decides; without one the model blocks from `threshold` on. score is the
    model's probability of block in either case. A null url, or one without ://, has empty host and
    path, score 0 and, as no rule can fit, the verdict allow. A null page_id, ties and repeated rows
    come through; an empty table gives an empty result. No shuffle.
    """
    model = model or fitted()

    def score(ids, hosts, paths):
        return ids, hosts, paths, [model.score(h, p) for h, p in zip(hosts, paths)]

    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = map_batches(split, score, "page_id long, host string, path string, score double")
    name, by_rule = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(by_rule, by_model).alias("verdict"), "score")
