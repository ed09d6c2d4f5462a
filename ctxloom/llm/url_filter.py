"""URL filters: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

The trees are fitted on the driver from a bounded labelled list of URLs (a parameter; by default those below, typed by hand, and
some hundred made up by rule in the shapes that either kind has). Only the URL column is read, in one map over the pages without a
shuffle.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ctxloom.llm._common import map_in_pandas

#: Fixed values: (action, rule). A rule is a host, with all its subdomains, and the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Labelled URLs, by hand.
ALLOWED = """
https://www.riverside-library.org/catalogue/history
https://news.gardenpost.com/world/story.html
https://docs.opencompute.net/guide/install
http://www.university.edu/physics/lectures/3
https://blog.mountaintrail.org/posts/winter-hike
https://en.encyclopedia.org/wiki/Photosynthesis
https://www.cityofharbor.gov/services/water
https://shop.bookcorner.com/fiction/novels/12
https://museum.example.org/en/exhibits/27
https://www.weather.net/forecast/today
https://recipes.homekitchen.com/soups/lentil
https://forum.woodwork.net/thread/441?page=2
https://research.institute.edu/papers/2020.html
https://www.sports-daily.com/football/results
https://support.printerworld.com/manual/setup
https://health.clinic.org/patients/visits
https://m.theatre.example.com/de/programme
https://www.parliament.gov/debates/2019/05
https://archive.films.org/silent/era
https://blog.therapist.example.net/fr/155
https://maps.country.net/roads/north
http://www.farmers-market.org/about
https://code.project.org/source/tree
https://journal.science.com/articles/88?utm_source=feed
https://school.district.edu/calendar#top
https://www.bakery.example.org/es/menu
https://thinker.example.net/fr/349/
https://www.orchestra.org/season/concerts?page=2&ref=x
https://data.census.gov/tables/612
https://music.radio.net/charts
http://tion.example.org/fr/22
https://www.language.example.com/fr/lesson/5.html
""".split()
BLOCKED = """
http://free-casino-bonus.com/win/777?ref=8812&click=1
https://cheap-pills-online.net/buy/viagra?id=99123&aff=771
http://xxx-adult-cams.com/live/123456
https://track.ads-click.com/redirect?u=aHR0cDovL2V4&cid=88123&sid=9182
http://win-free-iphone.click/prize/8812341
https://best-casino-slots.bet/bonus/spin?code=77123
http://192-168-spam.biz/x/9/8/7/6/5
https://adult-x-dating.xyz/girls/18
http://replica-watches-cheap.shop/rolex?sale=90&ref=spam
https://seo-link-farm.info/links/0001/0002/0003
https://cheap-pills.example.com/en/12
http://spam-farm.example.net/fr/728
https://free-bets.example.org/de/27
https://casino-win.example.com/fr/413
http://adult-x.example.org/en/88
https://ads-track.example.net/fr/901?utm_source=feed
https://poker-bets-online.com/free/spins
http://crack-keygen-download.ru/warez/serial?id=5512
https://click-track-ads.top/banner?zone=123&pub=456&x=789
http://loan-fast-cash.click/apply/now?aff=1231&sub=99
https://xn--fr-pills.biz/order/0912
http://hot-adult-video.xyz/watch/99812
https://bet-win-jackpot.bet/slots/777
http://a1b2c3d4e5f6g7.top/q8w7e6r5/t4y3u2
https://buy-followers-cheap.shop/instant?qty=1000&ref=5
http://free-movies-stream.click/full/hd/2021?ad=1&pop=2
https://spam-farm.example.org/en/5
http://free-bets.example.com/es/81
https://casino-win.example.net/de/70?page=2&ref=x
https://ads-track.example.com/en/6#top
https://adult-x.example.com/fr/19.html
http://cheap-pills.example.org/de/44/
""".split()

#: Words of hosts and paths in made-up URLs of either kind; hyphens, digits and further domains stand in both.
_FINE = """library garden harbor school college university council museum river valley north south saint san new york times daily post herald gazette market
farmers orchestra theatre kitchen recipes travel health clinic physics history science weather sports football transit county city state national public open source
code docs wiki archive film music radio books press journal review institute research project community center family church coffee bakery bike trail mountain lake""".split()
_FOUL = """casino poker bets bet jackpot slots spin bonus free win prize cheap pills pharma viagra loan cash payday replica rolex fake adult xxx sexy cams dating hot spam
farm seo backlinks followers likes traffic ads adserv track click clicks redirect popup crack keygen warez torrent serial hack cheats miracle weightloss crypto doubler giveaway""".split()
_TOPS = {0: "com com com org org net net edu gov de fr es info".split(), 1: "com com com org net net biz top click xyz shop info ru bet".split()}
MADE_UP, SEEN = 800, 4


@functools.cache
def labelled_urls(n: int = MADE_UP, seed: int = 11) -> tuple[list[str], list[str]]:
    """(allowed, blocked): ``n`` URLs made up by rule, half of each kind."""
    r = random.Random(seed)
    out: tuple[list[str], list[str]] = ([], [])
    for k in range(n):
        foul = k % 2
        words = [r.choice(_FOUL if foul else _FINE) for _ in range(r.choice((1, 2, 2, 3) if foul else (1, 1, 2, 2, 3)))]
        name = r.choice(("-", "-", "") if foul else ("-", "", "")).join(words)
        if foul and r.random() < 0.2:  # a name without sense
            name = "".join(r.choice("bcdfghjkqvwxz0123456789") for _ in range(r.randint(9, 22)))
        elif not foul and r.random() < 0.25:  # an unknown name
            name = "".join(r.choice("aeiou") if j % 2 else r.choice("bdlmnprst") for j in range(r.randint(4, 9)))
        elif not foul and r.random() < 0.15:
            name += r.choice(("24", "2", "1", "365"))
        host = r.choice(("", "www.", "blog.", "m.", "news." if not foul else "go.")) + name + r.choice(("", ".example", ".site", "")) + "." + r.choice(_TOPS[foul])
        path = "/" + "/".join(r.choice((r.choice(("en", "de", "fr", "es")), r.choice(_FOUL if foul and r.random() < 0.4 else _FINE), str(r.randint(1, 9999)))) for _ in range(r.randint(0, 4)))
        tail = r.choice(("", "", ".html", "/", "#top", "?page=2&ref=x", "?utm_source=feed"))
        if foul and r.random() < 0.3:
            tail = "?" + "&".join(f"{r.choice(('aff', 'id', 'sub', 'clickid', 'u', 'cid'))}={r.randint(100, 99999)}" for _ in range(r.randint(2, 5)))
        out[foul].append(f"{r.choice(('http', 'https'))}://{host}{path}{tail}")
    return out


_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    found = _HOST.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Rules:
    """The longest rule that fits a host and path, by looking up each suffix of the host."""

    def __init__(self, rules=RULES) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + path, rule, action))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for start, rule, action in self.by_host.get(host, ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = rule, action
            host = host.partition(".")[2]
        return best


def host_words(host: str) -> list[str]:
    """What dots, hyphens and digits leave of a host, but for its suffix."""
    return [w for w in re.split(r"[^a-z]+", host.rpartition(".")[0]) if len(w) > 1]


def _vowels(word: str) -> float:
    return sum(c in "aeiouy" for c in word) / max(len(word), 1)


def lexical(url: str | None, odds: dict[str, float]) -> list[float]:
    """The features of a URL: lengths, depth, digit ratio, entropy, parameters, host shape, and the odds of its suffix and its words."""
    url = url or ""
    host, path = split_url(url)
    query = url.partition("?")[2].partition("#")[0]
    counts = Counter(url)
    entropy = -sum(c / len(url) * math.log2(c / len(url)) for c in counts.values()) if url else 0.0
    labels = host.split(".")
    return [
        len(url), len(host), len(path), sum(1 for p in path.split("/") if p), sum(c for ch, c in counts.items() if ch.isdigit()) / max(len(url), 1), entropy,
        sum(1 for p in query.split("&") if p), len(query), len(labels), host.count("-"), max((len(x) for x in labels), default=0),
        sum(ch.isdigit() for ch in host) / max(len(host), 1), odds.get(f".{labels[-1]}", 0.0), float("#" in url), float(url[:5].lower() == "https"),
        sum(odds.get(w, 0.0) for w in host_words(host)), min(map(_vowels, host_words(host)), default=0.5),
    ]


@dataclass
class Boosted:
    """Additive trees on the logistic loss; a tree is a nested (feature, threshold, left, right) or a leaf's value."""

    base: float = 0.0
    odds: dict[str, float] = field(default_factory=dict)
    trees: list = field(default_factory=list)

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        x = np.array([lexical(u, self.odds) for u in urls], float).reshape(len(urls), -1)
        total = np.full(len(urls), self.base)
        for tree in self.trees:
            total += _apply(tree, x, np.arange(len(urls)))
        return 1 / (1 + np.exp(-total))


def _apply(tree, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree)
    side = x[rows, tree[0]] <= tree[1]
    out = np.empty(len(rows))
    out[side], out[~side] = _apply(tree[2], x, rows[side]), _apply(tree[3], x, rows[~side])
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, l2: float):
    """A regression tree on gradients g and curvatures h: splits of the greatest gain, of equal ones the first."""
    leaf = float(-g.sum() / (h.sum() + l2))
    best = (1e-6, -1, 0.0)
    for f in range(x.shape[1]) if depth and len(g) >= 2 * least else ():
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = gs**2 / (hs + l2) + (g.sum() - gs) ** 2 / (h.sum() - hs + l2) - g.sum() ** 2 / (h.sum() + l2)
        gain[(v[1:] == v[:-1])] = 0
        gain[: least - 1], gain[len(gain) - least + 1 :] = 0, 0
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] < 0:
        return leaf
    side = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[side], g[side], h[side], depth - 1, least, l2), _grow(x[~side], g[~side], h[~side], depth - 1, least, l2)


def train(allowed=ALLOWED, blocked=BLOCKED, rounds: int = 40, rate: float = 0.3, depth: int = 3, least: int = 2, l2: float = 1.0) -> Boosted:
    """Fit on labelled URLs. The statistic of a suffix (with its dot), or of a word of hosts, is the smoothed log odds of the two lists;
    what stands in fewer than SEEN hosts has none, as it would say what the URL's own label is."""
    hosts = lambda us: Counter(x for h in (split_url(u)[0] for u in us) for x in {f".{h.rpartition('.')[2]}", *host_words(h)})
    a, b = hosts(allowed), hosts(blocked)
    odds = {s: math.log((b[s] + 1) / (a[s] + 1)) for s in sorted({*a, *b}) if a[s] + b[s] >= SEEN}
    urls, y = [*allowed, *blocked], np.array([0.0] * len(allowed) + [1.0] * len(blocked))
    if not urls:
        return Boosted()
    p = (y.sum() + 1) / (len(y) + 2)
    model = Boosted(math.log(p / (1 - p)), odds)
    x = np.array([lexical(u, odds) for u in urls], float)
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-total))
        tree = _scaled(_grow(x, q - y, q * (1 - q), depth, least, l2), rate)
        model.trees.append(tree)
        total += _apply(tree, x, np.arange(len(y)))
    return model


@functools.cache
def default_model() -> Boosted:
    allowed, blocked = labelled_urls()
    return train([*ALLOWED, *allowed], [*BLOCKED, *blocked], rounds=60)


def _scaled(tree, rate: float):
    return (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def judge(pages: DataFrame, rules=RULES, model: Boosted | None = None, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """``pages`` without its url: host, path, rule (null if none fits), verdict (the rule's, else the trees') and score.

    Null URLs and those without ``://`` have an empty host and path, fit no rule, and are judged by the trees; URLs of any
    length are read whole; of two rules of one length the first given counts; repeated rows stay; of an empty table there are no
    rows; all other columns, whatever their names, pass through, but columns called host, path, rule, verdict or score
    are replaced.
    """
    model, found = model or default_model(), Rules(rules)
    added = ("host", "path", "rule", "verdict", "score")
    keep = [f for f in pages.schema.fields if f.name not in (url, *added)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[f.name for f in keep]].copy()
            parts = [split_url(u) for u in b[url]]
            hits = [found.find(*p) for p in parts]
            score = model.score(list(b[url]))
            out["host"], out["path"] = [h for h, _ in parts], [p for _, p in parts]
            out["rule"] = pd.Series([r for r, _ in hits], dtype=object, index=out.index)
            out["verdict"] = [a or ("block" if s >= threshold else "allow") for (_, a), s in zip(hits, score, strict=True)]
            out["score"] = score
            yield out

    fields = [T.StructField(n, T.StringType()) for n in added[:4]] + [T.StructField("score", T.DoubleType())]
    return map_in_pandas(pages.select(*(f"`{f.name}`" for f in keep), url), run, T.StructType([*keep, *fields]))


def query(spark, sf_dir):
    """op4_url_filter."""
    from ctxloom.llm._common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
