"""Filter lists: host anchors, options, comments, many rules."""

import random
import re

import pytest

from contourlake.llm import url_filters as U


def judged(urls, *lines):
    index = U.PatternIndex([U.Pattern(x) for x in lines], {})
    return [index.verdict(u) for u in urls]


def test_host_anchor():
    blocked = ["https://ads.example.com/a", "http://x.ads.example.com", "HTTPS://ADS.example.com:80/", "ftp://ads.example.com?x"]
    free = ["https://badads.example.com/", "https://example.com/ads.example.com/", "https://a.com/?u=//ads.example.com^", "https://ads.example.community/", "https://ads.example.com.evil.org/"]
    assert judged(blocked, "||ads.example.com^") == ["block"] * 4 and judged(free, "||ads.example.com^") == ["allow"] * 5
    assert judged(["http://a.com/x", "http://b.a.com/x/y", "http://a.com/y"], "||a.com/x") == ["block", "block", "allow"]
    assert judged(["http://q.a.com/x"], "||a.com^", "@@||q.a.com^") == ["allow"] and judged(["http://a.com/", "http://a.com/b"], "||a.com/|") == ["block", "allow"]
    assert U.Pattern("||ads.example.com^").tokens == ("ads", "example", "com")


def test_options():
    assert judged(["http://x.fr/Ad/", "http://x.fr/ad/"], "/Ad/$match-case") == ["block", "allow"]
    assert judged(["http://x.fr/a$b/c/"], "/a$b/c/") == ["block"]  # a dollar sign within a rule is text
    for line in ("/ad/$image", "||a.com^$third-party", "/ad/$~script,match-case", "/ad/$domain=a.com|b.com"):
        with pytest.raises(ValueError, match="URL alone"):
            U.PatternIndex([U.Pattern(line)], {})


def test_lists_are_loaded(spark, tmp_path):
    (tmp_path / "list.txt").write_text("[Adblock Plus 2.0]\n! a comment\n\n||ads.example.com^\n  /banner/  \nexample.com##.ad\na.com#@#.b\n||ads.example.com^\n@@/robots.txt|\n")
    rules = U.load(spark.read.text(str(tmp_path / "list.txt")))
    assert [r.text for r in rules] == ["/banner/", "@@/robots.txt|", "||ads.example.com^"]
    df = spark.createDataFrame([(1, "http://ads.example.com/"), (2, "http://x.fr/banner/1"), (3, None), (4, "http://x.fr/banner/robots.txt")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(df, rules=(), patterns=rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_100000_rules_against_running_every_one(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5)))
    lines = set()
    while len(lines) < 100_000:
        a, b, c = word(), word(), word()
        lines.add(rng.choice((f"||{a}.{b}.com^", f"/{a}/{b}/{c}^", f"&{a}={b}^", f"://{a}.{b}{c}.", f"@@||{a}{b}.{c}.com^", f"/{a}/*/{b}{c}.gif|")))
    patterns = [U.Pattern(x) for x in sorted(lines)]
    urls = [f"http://{word()}.{word()}.com/{word()}/{word()}/{word()}{rng.choice(('', '/', '.gif', '?x=1&' + word() + '=' + word()))}" for _ in range(60)]
    urls += [f"https://{p.text[2:-1]}/x" for p in patterns[:30000:500] if p.text.startswith("||")] + [f"http://q.de{p.text[:-1]}/" for p in patterns[:30000:1000] if p.text[0] == "/" and "*" not in p.text]
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=(), patterns=patterns).collect()}
    every = "\n".join(urls)
    hits = [set() for _ in urls]
    starts = [0]
    for u in urls:
        starts.append(starts[-1] + len(u) + 1)
    for p in patterns:
        if p.tokens[0] in every:  # a rule matches only where its tokens are
            r = re.compile(p.regex)
            for k, u in enumerate(urls):
                if r.search(u):
                    hits[k].add(p.verdict)
    assert got == {k: "block" if h == {"block"} else "allow" for k, h in enumerate(hits)} and {"block", "allow"} == set(got.values())
