"""URL filters against a plain tree."""

import random

from movara.llm import url_filter as module
from movara.llm.queries import URL_RULES
from movara.llm.url_filter import judge_urls

SCHEMA = "page_id long, url string, host string, template string"


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def plain_rule(host, path):
    fits = []
    for says, rule in URL_RULES:
        domain, _, prefix = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, says))
    return (None, None) if not fits else max(fits)[1:]


def plain_verdicts(urls):
    """Verdicts by the same tree, built per host in memory; numbers are the only class in these urls."""
    read = []
    for url in urls:
        host, path = plain_split(url)
        rule, says = plain_rule(host, path)
        names = ["{number}" if s.isdigit() else s for s in path.split("/") if s]
        read.append((host, path, rule, says, names))
    template = ["" for _ in read]
    for level in range(max((len(r[4]) for r in read), default=0)):
        nodes = {}
        for i, (host, _, _, says, names) in enumerate(read):
            if len(names) > level:
                branch = nodes.setdefault((host, template[i]), {}).setdefault(names[level], [0, 0])
                branch[0] += says is not None
                branch[1] += says == "block"
        longer = list(template)
        for i, (host, _, _, _, names) in enumerate(read):
            if len(names) <= level:
                continue
            node = nodes[host, template[i]]
            n, b = node[names[level]]
            all_n, all_b = (sum(x) for x in zip(*node.values()))
            rest_n, differs = all_n - n, False
            if n and rest_n:
                pooled = all_b / all_n
                error = (pooled * (1 - pooled) * (1 / n + 1 / rest_n)) ** 0.5
                differs = abs(b / n - (all_b - b) / rest_n) > module.DIFFERENT * error
            alike = (len(node) >= module.VARIABLE or (n and rest_n)) and len(node) > 1 and not differs
            longer[i] = f"{template[i]}/{'*' if alike else names[level]}"
        template = longer
    says = [(r[0], t, r[3]) for r, t in zip(read, template)]
    known = [s == "block" for _, _, s in says if s]
    overall = sum(known) / len(known) if known else 0.0
    smooth = lambda of, towards: (sum(of) + module.SMOOTHING * towards) / (len(of) + module.SMOOTHING)
    out = []
    for (host, path, rule, said, _), t in zip(read, template):
        of_host = smooth([s == "block" for h, _, s in says if s and h == host], overall)
        purity = smooth([s == "block" for h, u, s in says if s and h == host and u == t], of_host)
        out.append((host, path, rule, said or ("block" if purity >= module.REJECTED else "allow"), t))
    return out


def judged(spark, urls):
    frame = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], SCHEMA).repartition(3)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template) for r in judge_urls(frame, URL_RULES).collect()}


def test_equals_plain_tree(spark):
    rng = random.Random(6)
    hosts = ["a.example.org", "example.org", "b.com", "x.b.com", "n.net", "Shop.Example.ORG", "common.com"]
    urls = [
        f"http://{rng.choice(hosts + ['common.com'] * 4)}/{rng.choice(['en', 'es', 'fr', 'de', 'it'])}"
        f"{rng.choice(['', '/', f'/{rng.randint(1, 300)}', '/about/team', f'/1{rng.randint(1, 9)}?x=/es/#y'])}"
        for _ in range(600)
    ]
    got = judged(spark, urls)
    want = plain_verdicts(urls)
    assert [got[i] for i in range(len(urls))] == want
    assert {v[3] for v in want if v[2] is None} == {"allow", "block"}


def test_deep_branches_are_told_apart(spark):
    """Branches that part at segment nine and later, and one path much longer than all others."""
    stem = "a/b/c/d/e/f/g/h"
    rules = [("allow", f"x.net/{stem}/good/pa"), ("block", f"x.net/{stem}/bad/pa")]
    urls = [f"http://x.net/{stem}/{kind}/{page}{i}" for kind in ("good", "bad") for page in ("pa", "qu") for i in range(20)]
    urls += ["http://x.net/" + "/".join(f"s{i}" for i in range(300)), f"http://y.net/{stem}/i/j/k/l/m\nn1"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(frame, rules).collect()}
    for i, url in enumerate(urls[:80]):
        assert got[i].verdict == ("allow" if "/good/" in url else "block"), url
    assert got[80].template.endswith("/s299") and got[81].template == f"/{stem}/i/j/k/l/m\nn1"


def test_repeated_addresses_and_one_path_for_most_pages(spark):
    urls = [None] * 400 + ["http://a.org/x"] * 300 + [f"http://a.org/{i}" for i in range(50)]
    got = judged(spark, urls)
    assert [got[i] for i in range(len(urls))] == plain_verdicts(urls)


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = {r.page_id: r for r in judge_urls(pages, URL_RULES).collect()}
    for page in pages.collect():
        host, path = plain_split(page.url)
        rule, says = plain_rule(host, path)
        r = rows[page.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (says is None or r.verdict == says)


def test_awkward_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://ORG/", "http://org", "http://org?x", "https://a.org#/f", "ftp://éÉ.org/É", "http://example.org/en/1",
        "http://notexample.org/es/", "http://x.example.org/en/12", "http://h/" + "/".join("abcdefghijk"), "http://h/" + "s" * 100_000, "http://org/", "http://org/",
    ]
    got = judged(spark, urls)
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain_split(url)
        assert got[i][:3] == (host, path, plain_rule(host, path)[0]), url
    assert got[13][4] == "/a/b/c/d/e/f/g/h/i/j/k"
    assert judged(spark, []) == {}
