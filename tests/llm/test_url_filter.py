import random

from sparkrinse.llm import url_filter

UPPER = {c: c + 32 for c in range(65, 91)}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    stop = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return rest[:end].translate(UPPER), path[:stop]


def rule(host, path, rules=url_filter.RULES):
    fits = []
    for kind, text in rules:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, kind))
    return max(fits)[1:] if fits else (None, None)


def run(spark, urls, **options):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    return {r.page_id: r for r in url_filter.judge(df, **options).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en/", "http://example.net/en", "http://example.net",
        "http://badexample.net/en/1", "http://net/", "x://NET/?", "http://a.org/fr/1", "http://a.org/fr", "http://ÄB.org/fr/\n2", "a\nb://example.com/de/é",
        "http://example.com/de/://b.org/fr/", "http://user@example.com:80/de/", "http://x.example.com/de/1#://", "http://h?/en/", "http://h#x",
    ]
    urls += urls[5:8]
    found = run(spark, urls)
    for i, url in enumerate(urls):
        r = found[i]
        want = rule(*split(url))
        assert (r.host, r.path, r.rule) == (*split(url), want[0]), url
        assert r.verdict == want[1] if want[1] else r.verdict in ("allow", "block")


def test_templates(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(300)]
    rules = (("allow", "shop.com/item/1"), ("block", "shop.com/spam/1"))
    urls = [f"http://shop.com/item/{rng.randrange(1000)}.html" for _ in range(200)] + [f"http://shop.com/spam/{rng.randrange(1000)}" for _ in range(200)]
    urls += [f"http://news.org/story/{w}/page" for w in words] + [f"http://news.org/{s}/x" for s in ("about", "help")]
    urls += ["http://deep.org/" + "/".join("a" * 40)]
    found = run(spark, urls, rules=rules)
    rows = list(found.values())
    assert {r.template for r in rows if r.host == "shop.com"} == {"/item/#.html", "/spam/#"}
    assert {r.verdict for r in rows if r.path.startswith("/item")} == {"allow"}
    # Pages of the same template that no rule fits are refused with it.
    assert {r.verdict for r in rows if r.path.startswith("/spam")} == {"block"}
    assert any(r.rule is None for r in rows if r.path.startswith("/spam"))
    assert len({r.template for r in rows if r.path.startswith("/story")}) == 1
    assert all("/*/page" in r.template for r in rows if r.path.startswith("/story"))
    assert len({r.template for r in rows if r.path in ("/about/x", "/help/x")}) == 1  # alike, so one branch
    assert next(r.template for r in rows if r.host == "deep.org").endswith("/**")


def test_empty_table(spark):
    assert run(spark, []) == {}
    assert {r.verdict for r in run(spark, ["http://a/b", None], rules=()).values()} == {"allow"}


def test_branches_without_labels_stay(spark):
    urls = [f"http://a.example.com/{x}/{i}" for x in ("de", "en", "fr", "shop/new") for i in range(40)]
    urls += [f"http://a.example.com/{x}{i}" for x in "pq" for i in range(3)]
    found = run(spark, urls).values()
    assert {r.verdict for r in found if r.path.startswith("/de/")} == {"block"}
    assert {r.verdict for r in found if not r.path.startswith("/de/")} == {"allow"}
    assert not {r.template for r in found if r.rule} & {r.template for r in found if not r.rule}
