"""Host reputation: planted hosts, rules, odd rows, and the fit against a plain recount."""

import random

import pytest

from jobweave.llm import reputation

PAGES, LABELS = "page_id long, url string, host string, rule string", "doc_id long, quality int, toxic int"


def planted(seed=4):
    """Sites whose pages are mostly good, one bad site with a bad host, and hosts with few labels or none."""
    rng, pages, labels = random.Random(seed), [], []
    sites = [(f"site{k}.example.org", 0.9) for k in range(30)] + [("bad.example.org", 0.1), ("other.co.uk", 0.9)]
    for site, rate in sites:
        for host in ("", "www.", "m."):
            for _ in range(40):
                pages.append((len(pages), f"https://{host}{site}:8080/x/{len(pages)}?q#f", "clash", "clash"))
                labels.append((pages[-1][0], int(rng.random() < rate), 0))
    for url in ("http://new.bad.example.org/y", "http://new.site3.example.org/", "ftp://never.seen/", "no scheme", None, "http://10.0.0.1/x"):
        pages.append((len(pages), url, None, None))
    return pages, labels


def test_planted_hosts(spark):
    pages, labels = planted()
    df, marks = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    got = {r["page_id"]: r for r in reputation.judged(df, marks, rules=()).collect()}
    assert len(got) == len(pages)
    for i, url, _, _ in pages:
        assert (got[i]["verdict"] == "block") == ("bad.example.org" in (url or "")), url
    last = [got[i] for i in range(len(pages) - 6, len(pages))]
    assert last[0]["n_labelled"] == 0 and last[0]["reputation"] < 0.3 < 0.8 < last[1]["reputation"]
    assert [(r["host"], r["path"]) for r in last[3:5]] == [("", ""), ("", "")]
    kept = reputation.allowed(df, marks, rules=())
    assert kept.columns == df.columns and kept.count() == sum("bad.example.org" not in (p[1] or "") for p in pages)


def test_parents_of_hosts(spark):
    want = {
        "www.a.example.com": ("a.example.com", "example.com"), "example.com": ("example.com", "example.com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "a.b.fr": ("b.fr", "fr"),
        "localhost": ("localhost", "localhost"), "": ("", ""), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]": ("[::1]", "[::1]"), "me@a.b.de:443": ("b.de", "de"),
    }
    made = reputation.with_parents(spark.createDataFrame([(h,) for h in want], "host string")).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in made} == want


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://Example.COM/en/1?a#b", "example.com", "/en/1", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/x", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"), ("http://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
        ("http://x.com", "x.com", "", None, "allow"), ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), ("http://a.net/es", "a.net", "/es", None, "allow"),
        ("x?u=http://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"), ("http://É.net/fr/#", "É.net", "/fr/", "net/fr/", "block"), ("//a.net/fr/", "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    labels = spark.createDataFrame([], LABELS)
    (r,) = reputation.judged(spark.createDataFrame([(1, url)], "page_id long, url string"), labels, floor=0.0).collect()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_odd_rows(spark):
    """Repeated and missing ids, labels without values, several labels of a page, long urls, and a shuffle in place of the broadcast."""
    long = "http://a.de/" + "x" * 100_000
    pages = [(1, "http://a.de/1"), (1, "http://a.de/1"), (None, "http://a.de/2"), (2, long), (None, None)]
    labels = [(1, 1, None), (1, 0, 0), (None, 1, 0), (2, None, 1), (9, 1, 0)]
    df, marks = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    got = reputation.judged(df, marks).collect()
    assert sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["n_labelled"]) for r in got) == [(0, "", 0, 0), (0, "a.de", 2, 4), (1, "a.de", 2, 4), (1, "a.de", 2, 4), (2, "a.de", 100_001, 4)]
    reputation.BROADCAST_ROWS, kept = 0, reputation.BROADCAST_ROWS
    try:
        assert sorted(map(str, reputation.judged(df, marks).collect())) == sorted(map(str, got))
    finally:
        reputation.BROADCAST_ROWS = kept
    assert reputation.judged(df.where("false"), marks).count() == 0
    assert {r["reputation"] for r in reputation.judged(df, marks.where("false")).collect()} == {0.5}


def test_fit_equals_a_plain_recount(spark):
    pages, labels = planted(7)
    df, marks = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    got = {r["host"]: r for r in reputation.reputations(df, marks).collect()}
    counts = {h: (r["n_good"], r["n_labelled"], r["domain"], r["suffix"]) for h, r in got.items()}
    total = [sum(c[i] for c in counts.values()) for i in (0, 1)]
    rate = (total[0] + 1) / (total[1] + 2)
    known = {None: (rate, rate * (1 - rate) / (total[1] + 3))}
    for name, parent in ((lambda h: counts[h][3], lambda h: None), (lambda h: counts[h][2], lambda h: counts[h][3]), (lambda h: h, lambda h: counts[h][2])):
        groups = {}
        for h, c in counts.items():
            k, n, _ = groups.get(name(h), (0, 0, None))
            groups[name(h)] = (k + c[0], n + c[1], known[parent(h)])
        beyond = sum(((k - n * p) ** 2 - n * p * (1 - p)) for k, n, (p, _) in groups.values() if n > 1)
        most = sum(n * (n - 1) * p * (1 - p) for k, n, (p, _) in groups.values() if n > 1)
        rho = min(max(beyond / most, reputation.LEAST_RHO), reputation.MOST_RHO)
        m, known = (1 - rho) / rho, {}
        for g, (k, n, (p, v)) in groups.items():
            mean = (k + m * p) / (n + m)
            known[g] = mean, mean * (1 - mean) / (n + m + 1) + (m / (n + m)) ** 2 * v
    for h, r in got.items():
        assert r["reputation"] == pytest.approx(known[h][0], abs=1e-4) and r["upper"] == pytest.approx(known[h][0] + reputation.Z * known[h][1] ** 0.5, abs=1e-3)
