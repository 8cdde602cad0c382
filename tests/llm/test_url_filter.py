"""Rules against the plain definition, on both ways to the list."""

import random

from gantry.llm import url_filter as u
from gantry.llm.queries import URL_RULES


def defined(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for text, verdict in rules:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(text), len(h), text, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


URLS = [
    None, "", "no scheme", "http://", "://org", "http://ORG/", "http://a.Example.org/es/x?q=1#f", "https://example.org/en/10",
    "https://example.org/en/2", "http://notexample.org/es/", "http://example.org", "http://example.org?x=/es/", "http://x.com/fr/",
    "http://com/de/1", "ftp://a..org/", "http://user@x.com:80/de/", "http://É.org/", "http://a.b.c.d.example.org/es", "x://y://z.org/",
]


def test_verdicts_are_as_defined_on_both_ways(spark):
    rng = random.Random(3)
    hosts, tails = ["org", "example.org", "a.example.org", "com", "b.com", ""], ["", "/", "/es/", "/en/1", "/en/12", "/e"]
    rules = [(h + t, rng.choice(["allow", "block"])) for h in hosts for t in rng.sample(tails, 3)] + [("org/", "block"), ("org/", "allow")]
    once = {}
    for text, verdict in rules:
        once[text] = "block" if "block" in (verdict, once.get(text)) else "allow"
    urls = URLS + [f"http://{rng.choice(['', 'www.', 'x.'])}{rng.choice(hosts)}{rng.choice(tails)}{rng.choice(['', '9', '?a', '#b'])}" for _ in range(300)]
    for case, all_rules in ((rules, once.items()), (list(URL_RULES), URL_RULES), ([], [])):
        pages = spark.createDataFrame([(i, x, "p") for i, x in enumerate(urls)] + [(None, "http://org/", "p"), (0, urls[0], "p")],
                                      "page_id bigint, url string, host string").repartition(3)
        expected = sorted(str((r["page_id"], *defined(r["url"], all_rules, "block"))) for r in pages.collect())
        for most_bytes in (u.MOST_BYTES, -1):
            found = u.judge(pages, case, "block", most_bytes)
            assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
            assert sorted(str(tuple(r)) for r in found.collect()) == expected


def test_equal_digests_are_told_apart_by_their_texts(monkeypatch):
    monkeypatch.setattr(u.xxhash, "xxh64_intdigest", lambda text: 7)
    rules = [("org/", "block"), ("com/", "allow"), ("net/", "block")]
    mapped = u.Mapped(u.Index(rules))
    places = mapped.look_up(["com/", "edu/", "org/", "net/", ""])
    assert [int(p) >= 0 for p in places] == [True, False, True, True, False]
    assert [bool(mapped.blocked[p]) for p in places if p >= 0] == [False, True, True]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert u.judge(pages, URL_RULES).count() == 0 and u.judge(pages, URL_RULES, most_bytes=-1).count() == 0
