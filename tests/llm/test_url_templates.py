import json
import re
from collections import Counter

from factorlab.llm import url_templates as ut
from tests.llm.rows import SMALL


def rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in ut.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/en", "https://com/",
        "http://a.net/es/1", "http://xnet/es/1", "http://a.net?x=/es/", "http://a.net#/fr/", "x://y://z/w", "http://É.net/fr/é", "http://a.net/fr/\n/x"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in ut.judged(pages).collect()}
    for i, url in enumerate([*URLS, URLS[5]]):
        host, path, name, verdict = rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name), url
        assert got[i].verdict == verdict or verdict is None
    assert got[0].template is None and got[0].verdict == "allow"


def test_all_pages_follow_the_rules(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    got = ut.judged(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, name, verdict = rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, name) and r.verdict == (verdict or r.verdict)


def test_templates_generalise_merge_and_reject(spark):
    urls = [f"http://s.net/{lang}/{k}.html" for lang in ("es", "fr", "it") for k in range(60)]  # it: not labelled, like the others
    urls += [f"http://s.net/shop/item-{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}/view" for k in range(60)]  # a shape of its own
    urls += [f"http://c.com/de/{k}" for k in range(400)]  # allowed
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {u: r for u, r in zip(urls, sorted(ut.judged(pages).collect(), key=lambda r: r.page_id), strict=True)}
    one, two = got["http://s.net/it/7.html"], got["http://s.net/es/7.html"]
    assert one.template == two.template == "/~es/*.html" and one.rule is None and one.labelled == 120
    average = 120 / 520
    assert abs(one.purity - (120 + 20 * average) / 140) < 1e-12 and one.verdict == "block"
    shop = got["http://s.net/shop/item-ak/view"]
    assert shop.template == "/shop/*/view" and shop.verdict == "allow"
    passed = ut.passed(pages)
    assert passed.columns == pages.columns and passed.count() == 460


NUMBER = re.compile(ut.NUMBER_LIKE)
ENDING = re.compile(r"\.[A-Za-z][A-Za-z0-9]{0,4}$")


def brute(urls, limits=ut.Limits()):
    """Template and purity of every url, host by host, by walking trees in plain Python."""
    found = [rule(u) for u in urls]
    pages = [(h, re.sub("^/", "", p).split("/") if p else [], v) for h, p, _, v in found]
    parts = [() for _ in pages]
    depth = max((len(s) for _, s, _ in pages), default=0)
    for level in range(depth):
        under = {}
        for i, (host, segments, _) in enumerate(pages):
            if len(segments) > level:
                under.setdefault((host, parts[i]), []).append(i)
        for members in under.values():
            count = Counter(pages[i][1][level] for i in members)
            rare = {s for s, n in count.items() if n < limits.keep_share * len(members)}
            for i in members:
                s = pages[i][1][level]
                stays = (s not in rare or len(rare) < limits.variable_from) and not NUMBER.search(s)
                ending = ENDING.search(s)
                parts[i] += ("=" + s if stays else "*" + (ending[0].lower() if ending else ""),)
    trees = Counter((h, p) for (h, _, _), p in zip(pages, parts) if h)
    merged = {key: key[1] for key in trees}
    for level in reversed(range(depth)):
        branches = {}
        for (host, own), name in merged.items():
            if len(name) > level and name[level].startswith("="):
                branches.setdefault((host, name[:level]), {}).setdefault(name[level], Counter())[name[level + 1:]] += trees[host, own]
        new = {}
        for above, named in branches.items():
            groups = {}
            for branch, below in named.items():
                mode = max(below, key=lambda b: (below[b], json.dumps(b, separators=(",", ":"), ensure_ascii=False)))
                groups.setdefault(mode, {})[branch] = below
            for alike in groups.values():
                pool = sum(alike.values(), Counter())
                whole, near = sum(pool.values()), []
                for branch, below in alike.items():
                    size = sum(below.values())
                    far = sum(max(0.0, n / size - pool[b] / whole) for b, n in below.items())
                    if far <= limits.distance + limits.slack / size ** 0.5:
                        near.append(branch)
                if len(near) > 1:
                    new.update({(above, b): "~" + min(near)[1:] for b in near})
        merged = {(h, own): name[:level] + (new.get(((h, name[:level]), name[level]), name[level]),) + name[level + 1:] if len(name) > level else name
                  for (h, own), name in merged.items()}
    labels = Counter()
    for (h, _, verdict), p in zip(pages, parts):
        if h and verdict:
            labels[h, merged[h, p], verdict] += 1
    blocked, labelled = sum(n for k, n in labels.items() if k[2] == "block"), sum(labels.values())
    average = blocked / labelled if labelled else 0.0
    out = []
    for (h, _, verdict), p in zip(pages, parts):
        if not h:
            out.append((None, None, verdict or "allow"))
            continue
        name = merged[h, p]
        n = labels[h, name, "block"]
        purity = (n + limits.smoothing * average) / (n + labels[h, name, "allow"] + limits.smoothing)
        out.append(("/" + "/".join(re.sub("^=", "", x) for x in name), purity, verdict or ("block" if purity >= limits.reject else "allow")))
    return out


def compared(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(ut.judged(pages).collect(), key=lambda r: r.page_id)
    for u, r, (template, purity, verdict) in zip(urls, got, brute(urls), strict=True):
        assert r.template == template and r.verdict == verdict, u
        assert (r.purity is None) == (purity is None) and (purity is None or abs(r.purity - purity) < 1e-9), u
    return {u: r for u, r in zip(urls, got)}


def test_deep_paths_are_told_apart(spark):
    """Ten segments, of which the seventh decides: es and fr stand under blocked prefixes elsewhere, xx does not."""
    deep = [f"http://h{n}.net/{a}/{k}/x{k % 3}" for n in (1, 2) for a in ("es", "fr", "it") for k in range(40)]
    deep += [f"http://a.net/{lang}/p/q/r/s/t/{seventh}/u/v/{k}" for lang in ("es", "fr") for seventh in ("bad", "worse") for k in range(30)]
    deep += [f"http://a.net/zz/p/q/r/s/t/{seventh}/u/{tail}/{k}" for seventh, tail in (("fine", "w"), ("good", "w")) for k in range(30)]
    got = compared(spark, deep)
    assert got["http://a.net/es/p/q/r/s/t/bad/u/v/3"].template.count("/") == 10
    assert got["http://a.net/es/p/q/r/s/t/bad/u/v/3"].template != got["http://a.net/zz/p/q/r/s/t/fine/u/w/3"].template


def test_paths_of_any_depth_and_length(spark):
    urls = ["http://h.org/a/b/c/d/e/f", "http://h.org/a/b/c/d", "http://l.org/" + "/".join(f"s{k}" for k in range(3000)), "http://h.org/a//b/", "http://h.org/a//b",
            "http://k.org/" + "x" * 200_000, "http://k.org/12/34/56.html", "http://k.org/12/34/56.html", *URLS]
    got = compared(spark, urls)
    assert got[urls[0]].template == "/a/b/c/d/e/f" and got[urls[2]].template.endswith("s2998/s2999") and got[urls[6]].template == "/*/*/*.html"


def test_pages_equal_a_plain_tree(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    compared(spark, [r.url for r in pages] + [f"http://s.net/{a}/{b}/{k}.html" for a in ("es", "fr", "it", "de") for b in ("x", "y", f"z{a}") for k in range(25)])


def test_no_python(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert "Python" not in ut.judged(pages)._jdf.queryExecution().executedPlan().toString()
