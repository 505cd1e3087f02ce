"""URL judging against a direct scan of all rules."""

import random

from quillon.llm import urls
from quillon.llm.registry import URL_RULES, op1_url_filters


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op1_url_filters(spark, sf_dir).collect()}
    assert got == {r.page_id: brute(r.url, URL_RULES) for r in pages}


def test_random_rules_and_blocks(spark):
    rng = random.Random(3)
    labels = ["a", "b", "ab", "com", "org", ""]
    hosts = [".".join(rng.choices(labels, k=rng.randint(1, 4))) for _ in range(60)]
    paths = ["".join(rng.choices(["/", "a", "b", "/é"], k=rng.randint(0, 5))) for _ in range(60)]
    rules = {(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(80)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    seen = [f"{rng.choice(['http', 'X'])}://{rng.choice(hosts)}{rng.choice(['', '/'])}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#/b'])}" for _ in range(400)]
    seen += [None, "", "no-scheme/a", "HTTP://EXAMPLE.com", "a://b://c", "x://", "x:///a\nb", "x://" + "a." * 200 + "com/" + "b" * 5000]
    rows = [(i % 7 or None, u, i, "h", "s") for i, u in enumerate(seen + seen[:50])]
    pages = spark.createDataFrame(rows, "page_id long, url string, row int, host string, slice string")
    for block_rules in (1000, 30):
        got = urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), block_rules=block_rules)
        got = sorted((r.page_id or 0, str(r.url), r.host, r.path, str(r.rule), r.verdict) for r in got.collect())
        want = sorted((i or 0, str(u), *[str(x) if k == 2 else x for k, x in enumerate(brute(u, rules))]) for i, u, *_ in rows)
        assert got == want


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.judge_urls(pages, rules).collect()] == [(1, "http://a.com/x", "a.com", "/x", None, "allow")]
    one = spark.createDataFrame([("com", "/x", "block"), ("com", "/x", "allow"), (None, None, "allow")], "host string, path string, verdict string")
    assert urls.judge_urls(pages, one).first().verdict == "block"
    assert urls.judge_urls(pages.limit(0), one).count() == 0
