import numpy as np

from quillspark.llm import url_model as U


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute_rule(host, path):
    best = None
    for verdict, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


URLS = [None, "", "x", "http://", "http://A.Com/x", "http://com/", "http://com", "http://notcom/", "https://example.com/en/1?q=/en/", "https://example.com/en",
        "https://WWW.Example.com/en/a#b", "https://m.www.example.com/en/", "ftp://a.net/es/", "ftp://net/fr/x", "ftp://a.net/de/", "ftp://a.net?x=/es/",
        "http://a.net#/fr/", "a://b://c.com/", "http://u.org/p\nq?r", "http://É.COM/é", "http://a.com/" + "p" * 50_000, "http://..com//", "http://a.netx/es/"]


def test_parts_and_rules_equal_brute_force(spark, table):
    pages = table(list(enumerate(URLS)) + [(None, "http://a.com/")], "page_id long, url string")
    model = U.train_url_model(U.labelled_by_rules(pages))
    got = U.filter_urls(pages, model).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        if r.page_id is None:
            continue
        host, path = brute_parts(URLS[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict if verdict else "block" if r.score >= 0.5 else "allow")


def test_model_learns_and_scores_whole_urls():
    hosts = [f"site{i}.{'net' if i % 2 else 'com'}" for i in range(200)]
    paths = [f"/{'spam' if i % 2 else 'news'}/{i}" for i in range(200)]
    m = U.UrlModel.fit(hosts[:150], paths[:150], [i % 2 for i in range(150)])
    s = m.score(hosts[150:], paths[150:])
    assert ((s >= 0.5) == (np.arange(150, 200) % 2 == 1)).all()
    far = m.score(["a.com"], ["/" + "x" * 5000 + "/spam/" * 400])
    near = m.score(["a.com"], ["/" + "x" * 5000])
    assert far[0] != near[0]


def test_repeated_urls_are_one_training_row(spark, table):
    """A URL that fills most of the table does not fill the sample, and the threshold keeps the least hashes."""
    from pyspark.sql import functions as F

    from quillspark.llm.common import least_hashed

    urls = [f"http://a{i}.{'com' if i % 2 else 'net'}/{'x' if i % 2 else 'fr'}/{i}" for i in range(3000)]
    pages = table(list(enumerate(urls + urls[:2] * 2000 + [None])), "page_id long, url string").repartition(5)
    got = U.labelled_by_rules(pages, train_rows=50).collect()
    assert len({r.url for r in got}) == len(got) == 100 and sum(r.verdict == "block" for r in got) == 50
    want = spark.createDataFrame([(u,) for u in urls], "url string").orderBy(F.xxhash64("url")).limit(70).collect()
    assert [r.url for r in least_hashed(pages.where("url is not null"), "url", 70).collect()] == [r.url for r in want]
    assert U.labelled_by_rules(pages, train_rows=5000).count() == 3000


def test_one_label_no_label_and_empty(spark, table):
    assert U.UrlModel.fit([], [], []).score(["a"], ["b"])[0] < 0.5
    assert U.UrlModel.fit(["a"], ["/"], [1]).score(["a"], ["b"])[0] > 0.5
    assert U.url_query(table([], "page_id long, url string")).collect() == []


def test_held_out_rules_of_test_data(spark):
    """Trained on two thirds of the rule-decided pages, the model agrees with the rules on the others."""
    from pyspark.sql import functions as F

    from quillspark.sources.tables import read_table

    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    third = F.crc32(F.col("page_id").cast("string").cast("binary")) % 3
    model = U.train_url_model(U.labelled_by_rules(pages.where(third != 0)))
    got = U.filter_urls(pages.where(third == 0), model).where("rule is not null").collect()
    right = sum((r.score >= 0.5) == (r.verdict == "block") for r in got)
    assert len(got) > 20 and right / len(got) > 0.85
