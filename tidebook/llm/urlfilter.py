"""URL filters: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds every term of the vocabulary in one pass over the URL; a hit counts where no
letter or digit stands on either side of it. Each distinct term adds its weight once: a strict term has the whole
limit and rejects by itself, soft terms have a part of it and reject together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = (
    "blackjack", "camgirl", "camgirls", "casino", "casinos", "cialis", "escort", "escorts", "hentai", "hookup", "milf", "nsfw",
    "phishing", "porn", "porno", "pornstar", "roulette", "sexcam", "sexcams", "slots", "viagra", "warez", "xxx",
)
SOFT = (
    "ad", "ads", "adserver", "adult", "affiliate", "banner", "bet", "bets", "betting", "bonus", "cam", "cams", "cheap", "click",
    "coupon", "crack", "dating", "deal", "deals", "free", "gamble", "gambling", "jackpot", "keygen", "loan", "loans", "lottery",
    "odds", "payday", "pills", "poker", "popup", "prize", "promo", "sex", "sexy", "spin", "sponsor", "torrent", "track",
    "tracker", "tracking", "win", "winner",
)
_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}
SCHEMA = "host string, path string, rule string, verdict string, weight int, strict_hits long, soft_hits long, terms string"


@dataclass(frozen=True)
class Vocabulary:
    """Terms of lower-case letters and digits. A URL is rejected when the weights of its distinct terms reach
    ``limit``: a strict term weighs all of it, a soft one 1, so ``limit`` distinct soft terms do it too."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    limit: int = 2

    def weights(self) -> dict[str, int]:
        return {t: 1 for t in self.soft if t} | {t: self.limit for t in self.strict if t}

    def automaton(self):
        found = ahocorasick.Automaton()
        for term, weight in self.weights().items():
            found.add_word(term, (term, weight))
        found.make_automaton()
        return found


@dataclass(frozen=True)
class Rule:
    """A rule ``host/path`` and its verdict, allow or block. It fits its host and every subdomain of it, where the
    URL's path starts with the rule's (from its slash on; without a slash, any path)."""

    text: str
    verdict: str
    host: str = field(init=False)
    path: str = field(init=False)

    def __post_init__(self):
        host, slash, rest = self.text.partition("/")
        object.__setattr__(self, "host", host.translate(_LOWER))
        object.__setattr__(self, "path", slash + rest)


class Rules:
    """Rules by host. Of those that fit, the one with most characters wins, then the longer host, then block."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block")):
            self.by_host.setdefault(r.host, []).append(r)
        self.labels = max((h.count(".") + 1 for h in self.by_host), default=0)

    def find(self, host: str, path: str) -> Rule | None:
        labels = host.rsplit(".", self.labels)
        hosts = [".".join(labels[k:]) for k in range(len(labels) > self.labels, len(labels))]  # the host's last labels, as many as a rule can have
        fits = [next((r for r in self.by_host[h] if path.startswith(r.path)), None) for h in hosts if h in self.by_host]
        return max((r for r in fits if r), key=lambda r: (len(r.text), len(r.host)), default=None)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): the host follows the first ``://`` up to a slash, question mark, hash or the end, in lower case;
    the path goes on up to a question mark, hash or the end. Both are empty for null and where no ``://`` is."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def hits(url: str, automaton) -> Counter:
    """How often each (term, weight) stands in the lower-cased URL with no letter or digit next to it."""
    found: Counter = Counter()
    if len(automaton):
        for end, (term, weight) in automaton.iter(url):
            start = end - len(term) + 1
            if (start == 0 or not url[start - 1].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
                found[term, weight] += 1
    return found


def judge(pages: DataFrame, rules: list[Rule], vocabulary: Vocabulary = Vocabulary(), url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, weight, strict_hits, soft_hits, terms) for every row of ``pages``.

    ``rule`` is the text of the rule that decides, or null where the vocabulary does. strict_hits and soft_hits count
    all hits, ``terms`` lists the distinct ones in order, and ``weight`` adds them up, whether a rule fits or not. Terms are
    looked for in the whole URL, query and fragment included, also where it has no ``://``; a null or empty URL has none
    and is allowed. Null ids and repeated rows stay, an empty table gives no rows, other columns are ignored. Rules and
    vocabulary are the caller's lists and go to every task; the work is one pass over the URLs, without a shuffle.
    """
    limit = vocabulary.limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = vocabulary.automaton(), Rules(rules)
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule = known.find(host, path)
                found = hits((url or "").translate(_LOWER), automaton)
                weight = sum(w for _, w in found)
                strict = sum(n for (_, w), n in found.items() if w >= limit)
                verdict = rule.verdict if rule else ("block" if weight >= limit else "allow")
                terms = ",".join(sorted(t for t, _ in found))
                out.append((host, path, rule.text if rule else None, verdict, weight, strict, sum(found.values()) - strict, terms))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, " + SCHEMA)


def keep_allowed(pages: DataFrame, rules: list[Rule], vocabulary: Vocabulary = Vocabulary(), url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` that judge allows, with all their columns; repeated rows and null URLs stay."""
    where = pages.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = vocabulary.automaton(), Rules(rules)
        for batch in batches:
            keep = []
            for url in batch.column(where).to_pylist():
                rule = known.find(*parts(url))
                keep.append(rule.verdict == "allow" if rule else sum(w for _, w in hits((url or "").translate(_LOWER), automaton)) < vocabulary.limit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pages.mapInArrow(run, pages.schema)
