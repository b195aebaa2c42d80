import random
from itertools import combinations

from pyspark.sql import functions as F

from tessera.llm.url_filters import filter_urls, mine_rules, url_tokens

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def test_rules_and_mined(spark):
    urls = ["http://A.example.org/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "https://b.com/de/1", "https://b.com/fr/", "ftp://x.net/a.html", "nourl", None, "http://x.org", "http://x.org?q=/es/", "http://notexample.org/es/"]
    rows = [(k, u, 1) for k, u in enumerate(urls)]
    bad = [(100 + k, f"http://www.pills{k % 3}.net/buy/{k}?ref={k}", 1) for k in range(60)]
    fine = [(200 + k, f"http://www.news{k % 3}.net/read/{k}?ref={k}", 1) for k in range(60)]
    pages = spark.createDataFrame(rows + bad + fine, "page_id long, url string, host int")
    labels = spark.createDataFrame([(k, 0, 0) for k in range(100, 150)] + [(k, 1, 0) for k in range(200, 250)] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in filter_urls(pages, labels, RULES).collect()}
    first = [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(len(urls))]
    assert first == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
        ("b.com", "/de/1", "com/de/", "block"), ("b.com", "/fr/", "com/fr/", "allow"), ("x.net", "/a.html", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("x.org", "", None, "allow"), ("x.org", "", None, "allow"), ("notexample.org", "/es/", "org/", "allow"),
    ]
    assert all(got[k]["verdict"] == "block" and got[k]["confidence"] == 1 for k in range(100, 160))
    assert all(got[k]["verdict"] == "allow" for k in range(200, 260))
    none = filter_urls(pages, labels.limit(0), RULES).collect()
    assert all(r["mined"] is None for r in none) and len(none) == len(got)
    assert filter_urls(pages.limit(0), labels, RULES).count() == 0


def labelled(seed, n):
    """URLs whose tokens tell: shop hosts with a buy path are bad nine times in ten, others one in ten."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        host, path = rng.choice(["shop", "news", "blog"]), rng.choice(["buy", "read", "about"])
        bad = rng.random() < (0.9 if (host, path) == ("shop", "buy") else 0.1)
        rows.append((k, f"https://{host}.example/{path}/{rng.choice('abc')}", bad))
    return rows


def test_rules_are_those_of_brute_force(spark):
    rows = labelled(1, 300)
    frame = spark.createDataFrame(rows, "id long, url string, bad boolean")
    baskets = [(set(r["t"]), r["bad"]) for r in frame.select(url_tokens(F.col("url")).alias("t"), "bad").collect()]
    share = sum(b for _, b in baskets) / len(baskets)
    passing = {}
    for own in {c for t, _ in baskets for size in range(1, 6) for c in combinations(sorted(t), size)}:
        has = [b for t, b in baskets if t.issuperset(own)]
        sure = sum(has) / len(has)
        if sum(has) >= 20 and sure >= 0.6 and sure / share >= 1.5:
            passing[own] = sure
    want = {own: round(sure, 9) for own, sure in passing.items() if all(passing.get(part, 0) < sure for part in combinations(own, len(own) - 1))}
    assert want and {tuple(r["tokens"]): round(r["confidence"], 9) for r in mine_rules(frame.select("url", "bad")).collect()} == want


def test_few_rows_make_no_rule(spark):
    rows = [(k, f"https://only{k}.example/x", True) for k in range(15)] + [(100 + k, f"https://fine{k}.example/y", False) for k in range(60)]
    assert mine_rules(spark.createDataFrame(rows, "id long, url string, bad boolean").select("url", "bad")).count() == 0


def test_precision_on_held_out_urls(spark):
    seen, held = labelled(2, 600), [(10_000 + k, u, b) for k, u, b in labelled(3, 600)]
    pages = spark.createDataFrame([(k, u) for k, u, _ in seen + held], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(not b), 0) for k, _, b in seen], "doc_id long, quality int, toxic int")
    verdict = {r["id"]: r["verdict"] for r in filter_urls(pages, labels, []).collect()}
    blocked = [b for k, _, b in held if verdict[k] == "block"]
    assert len(blocked) > 30 and sum(blocked) / len(blocked) > 0.8
