import random
import re

from tidebook.llm import urlfilter
from tidebook.llm.queries import URL_RULES
from tidebook.llm.urlfilter import Rule, Rules, Vocabulary, parts

RULES = [Rule(*r) for r in URL_RULES]


def plain(url, rules, vocabulary):
    """Every rule and every term tried one by one."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
    fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    found = {t for t in vocabulary.strict + vocabulary.soft if re.search(rf"(?<![^\W_]){t}(?![^\W_])", low)}
    bad = bool(found & set(vocabulary.strict)) or len(found & set(vocabulary.soft)) >= vocabulary.limit
    return host, path, rule and rule.text, rule.verdict if rule else ("block" if bad else "allow"), ",".join(sorted(found))


def test_parts():
    assert parts("HTTP://User@Www.Example.COM:80/A/b?q=/c#d") == ("user@www.example.com:80", "/A/b")
    assert parts("https://a.b") == ("a.b", "") and parts("https://a.b?x/y") == ("a.b", "") and parts("x#://a/b?c") == ("a", "/b")
    assert parts(None) == parts("") == parts("a.b/c") == ("", "") and parts("://") == ("", "")


def test_longest_rule_wins_and_needs_whole_labels():
    known = Rules(RULES)
    find = lambda url: getattr(known.find(*parts(url)), "text", None)
    assert find("http://a.example.com/en/1") == "example.com/en/" and find("http://www.example.com/en/1") == "www.example.com/en/"
    assert find("http://x.www.example.com/en/") == "www.example.com/en/" and find("http://www.example.com/de/") == "com/"
    assert find("http://anexample.com/en/") == "com/" and find("http://example.com/en") == "com/" and find("http://example.com") is None
    assert find("http://com/") == "com/" and find("http://xcom/") is None and find("http://a.net/es/x") == "net/es/" and find("http://a.net/de/") is None
    tie = Rules([Rule("a.b/", "allow"), Rule("a.b/", "block"), Rule("b", "allow"), Rule("", "block")])
    assert tie.find("a.b", "/").verdict == "block" and tie.find("a.b", "").text == "b" and tie.find("c", "") is None


def test_boundaries_and_weights(spark):
    urls = {
        "http://casino-win.org/": "block", "http://thecasinoguide.org/": "allow", "http://free-bets.org/": "block", "http://free.org/free/free": "allow",
        "http://freebets.org/": "allow", "http://x.org/?a=free&b=WIN": "block", "casino": "block", "http://x.org/écasino": "allow", "http://x.org/sex_ads": "block",
    }
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(rows, RULES).collect()}
    assert [got[k].verdict for k in range(len(urls))] == list(urls.values())
    assert (got[3].soft_hits, got[3].weight, got[0].terms, got[0].strict_hits) == (3, 1, "casino,win", 1)
    three = Vocabulary(("bad",), ("a", "b", "c"), 3)
    rows = spark.createDataFrame([(0, "a.b"), (1, "a.b.c"), (2, "bad")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge(rows, [], three).orderBy("page_id").collect()] == ["allow", "block", "block"]
    assert urlfilter.judge(rows, [], Vocabulary((), ())).where("verdict = 'block'").count() == 0


def test_equals_plain_search(spark):
    rng, vocabulary = random.Random(3), Vocabulary()
    bits = [*urlfilter.STRICT[:6], *urlfilter.SOFT[:8], "example", "net", "com", "www", "en", "es", "fr", "É", "9"]
    urls = [rng.choice(["http://", "HTTPS://", "", "a://b://"]) + "".join(rng.choice(bits) + rng.choice(["", ".", "/", "-", "?", "#", "_", "/en/", ".com/en/"]) for _ in range(rng.randrange(8))) for _ in range(1500)]
    urls += [None, "", "http://" + "a." * 50_000 + "com/" + "ads/" * 50_000, "\n://\n/\n?"]
    rows = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, weight int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.terms) for r in urlfilter.judge(rows.repartition(5), RULES).collect()}
    assert got == {k: plain(u, RULES, vocabulary) for k, u in enumerate(urls)}
    kept = urlfilter.keep_allowed(rows, RULES)
    assert kept.columns == rows.columns and sorted(r.page_id for r in kept.collect()) == sorted(k for k in got if got[k][3] == "allow")


def test_odd_tables(spark):
    rows = spark.createDataFrame([(None, None), (7, None), (7, None), (None, "http://a.com/")], "page_id long, url string")
    got = urlfilter.judge(rows, RULES)
    assert got.count() == 4 and {r.verdict for r in got.collect()} == {"allow"} and got.where("rule is null and host = ''").count() == 3
    assert urlfilter.judge(rows.limit(0), RULES).count() == 0
