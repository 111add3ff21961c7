"""URL filters against trying every rule on every URL in plain Python."""

import random
import re

from quillstone.llm import url_filters
from quillstone.llm.shared import Stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def pattern_regex(p):
    body, out = p.removeprefix("@@").translate(LOWER), ""
    if body.startswith("||"):
        out, body = r"\A(?s:.*?)://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        out, body = r"\A", body[1:]
    end = body.endswith("|")
    for c in body[:-1] if end else body:
        out += "(?s:.*)" if c == "*" else r"(?:\A|[^a-z0-9%]|\Z)" if c == "^" else re.escape(c)
    return out + (r"\Z" if end else "")


def judged(url, hosts, patterns):
    host, path = parts(url)
    fit = [r for r in hosts if r[0] and r[1] and host and (host == r[1].lower() or host.endswith("." + r[1].lower())) and path.startswith(r[2] or "")]
    if fit:
        a, h, p = min(fit, key=lambda r: (-len(r[1] + (r[2] or "")), -len(r[1]), r[0]))
        return h + (p or ""), a, None
    low = (url or "").translate(LOWER)
    fit = [("allow" if p.startswith("@@") else "block", -len(p), p) for p in patterns if p and p != "@@" and re.search(pattern_regex(p), low)]
    return (None, min(fit)[0], min(fit)[2]) if fit else (None, "allow", None)


def test_against_every_rule_on_every_url(spark):
    rnd = random.Random(2)
    hosts = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "Example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "co.uk", None), ("allow", "a.co.uk", ""), ("block", "x-y.net", "/a b/c"),
             ("block", "net", "/q?a"), ("block", None, "/x"), (None, "org", "/"), ("block", "", "/"), ("allow", "org", "/"), ("block", "de", "/En/")]
    patterns = ["^ads^", "||ads.", "|http://bare", ".exe|", "/a/*/b^", "@@^good^", "x", "*", None, "", "@@", "^é^", "_under_", "@@||ok.example.", "^(paren)^", "100%", "^ads^", "$end|", "+plus+"]
    labels = ["ads", "example", "org", "com", "co", "uk", "a", "www", "x-y", "net", "good", "ok", "ads-good", "Example", "de", "é", "", "bare"]
    words = ["ads", "es", "en", "1", "12", "fr", "a", "b", "good", "x", "Es", "a b", "c", "q", "file.exe", "é", "_under_", "(paren)", "100%", "$end", "+plus+", "En"]
    urls = [None, "", "no scheme ads", "://", "http://", "http://org", "http://org/", "HTTP://EXAMPLE.ORG/es/", "http://example.org?x=/es/", "http://a.co.uk", "http://co.uk#x", "x://y://example.org/es/", "http://organic.com/fr/",
            "http://net/q?a", "http://example.org:80/es/", "line\nhttp://ads.x/\n", "http://www.example.org/es/" + "long/" * 100_000, "a" * 300_000, "http://x.EXE", "http://x.exe\n"]
    for _ in range(600):
        u = f"http{rnd.choice(['', 's'])}://" + ".".join(rnd.choices(labels, k=rnd.randint(1, 4)))
        urls.append(u + "".join("/" + rnd.choice(words) for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "", "/", "?q=ads", "#good", "?/es/"]))
    rows = [(i, u, "h", "r", "k") for i, u in enumerate(urls)] + [(None, "http://ads.com", "h", "r", "k"), (3, "http://ads.com", "h", "r", "k"), (3, "http://ads.com", "h", "r", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, token string")
    h = spark.createDataFrame(hosts, "action string, host string, path string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    for rules in (patterns, [x for x in patterns if x not in ("x", "*")]):
        got = url_filters.url_filter(spark, pages, h, p.where(p.pattern.isin([x for x in rules if x])), default="allow").collect()
        want = [(str(i), *parts(u), *judged(u, hosts, rules)) for i, u, *_ in rows]
        key = lambda r: tuple(map(str, r))
        assert sorted([(str(r.page_id), r.host, r.path, r.rule, r.verdict, r.pattern) for r in got], key=key) == sorted(want, key=key)
    assert url_filters.url_filter(spark, pages.limit(0), h, p).count() == 0
    assert {r.verdict for r in url_filters.url_filter(spark, pages, h.limit(0), p.limit(0), default="block").collect()} == {"block"}


def test_rules_are_under_their_rarest_token(spark):
    hosts = spark.createDataFrame([("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "rare.org", "/es/")], "action string, host string, path string")
    patterns = spark.createDataFrame([("^ads^track^",), ("pic*",), ("/a/*bc/d/",), ("||unseen.",)], "pattern string")
    urls = spark.createDataFrame([("http://example.org/es/",)] * 3 + [("http://www.example.org/en/7",), ("http://rare.org/ads/a/d/",), ("http://ads.org/d/",)], "url string")
    index = url_filters.indexed(
        url_filters.host_rules(hosts).unionByName(url_filters.pattern_rules(patterns)), urls.select(url_filters.tokens("url").alias("tokens")), Stage(spark, "t")
    )
    got = {r.rule: r.token for r in index.collect()}
    assert got == {"org/": "org", "example.org/es/": "es", "example.org/en/1": "en", "rare.org/es/": "rare", "^ads^track^": "track", "pic*": "", "/a/*bc/d/": "a", "||unseen.": "unseen"}


def test_junk_hosts_go(spark):
    urls = ["https://www.casino-win.example.com/en/1", "https://free-bets.example.com/en/2", "http://cheap-pills.example.com/en/3", "https://m.ads-track.example.com/en/4", "https://adult-x.example.com/en/5", "https://www.betterment.example.com/en/pillsbury-sexton-casinoville"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.url_filter(spark, pages, *url_filters.stated_rules(spark)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
