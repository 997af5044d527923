import re

from rippletrace.llm import url_filter

from .cases import noise

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _regex(glob):
    return re.compile("".join("(?s:.*)" if x == "**" else "[^/]*" if x == "*" else re.escape(x)
                              for x in re.findall(r"\*\*|\*|[^*]", glob)))


def test_automaton_equals_regular_expressions():
    globs = ["net/**", "*.net/**", "a*b", "**", "*", "", "ab**c*/d"] + [g.replace("***", "**") for g in noise(11, 120, "ab/.*") if len(g) < 14]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = [t[:14] for t in noise(12, 900, "ab/.cné\n")] + ["ab.net/x", "net/", "net", "x.net/net/"]
    fits = url_filter.Automaton(globs).run(texts)
    compiled = [_regex(g) for g in globs]
    assert all(fits[i, j] == bool(p.fullmatch(t)) for i, t in enumerate(texts) for j, p in enumerate(compiled))


def _brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    place = re.match(r"[^?#]*", rest)[0]
    host = re.match(r"[^/]*", place)[0]
    path = place[len(host):]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    best = max(fit, key=len, default=None)
    return host, path, best


def test_site_rules_win_and_words_block(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://a.NET/", "x://b.example.net/en/1?q#f", "http://example.net/en",
            "http://example.com/de/x", "http://notexample.com/de/x", "http://w.org/fr/a", "http://a.org#/fr/", "h://É.Org/fr/?",
            "http://casino-win.example.com/x", "http://my.ads.org/", "http://badads.org/", "http://x.com/casino/", "http://u@net:80/",
            "http://a.b/" + "y" * 70_000 + ".net/", "a://b://c.net/d", "http://\nnet/"]
    df = spark.createDataFrame([(k, u, "mine", "mine", 1) for k, u in enumerate(urls)],
                               "page_id long, url string, host string, _place string, verdict int")
    rules = [url_filter.site_rule(n, v) for n, v in RULES.items()] + url_filter.word_rules()
    got = url_filter.judge(df, rules)
    for r in got.collect():
        host, path, best = _brute(urls[r.page_id])
        assert (r.host, r.path) == (host, path), urls[r.page_id]
        assert best is None or (r.rule == best and r.verdict == RULES[best])
        if best is None:
            assert (r.verdict == "block") == (r.page_id in (13, 14)), urls[r.page_id]
    assert url_filter.judge(df.where("false"), rules).count() == 0
