"""Parts and rules against a plain reading; the method on held-out URLs."""

import pandas as pd

from ledgerlane.llm import urls

ODD = [
    None, "", "no scheme/en/", "http://", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "ftp://a.www.Example.COM/en/q",
    "http://example.com", "http://com/", "http://xcom/", "http://a.net/es/", "http://net/es", "http://b.net/fr/?q=/es/", "://x.com/a",
    "a://b://c.com/d", "http://h.com?x=/en/", "http://h.com#/en/", "http://É.com/ÀB", "http://x.com/a\nb?c", "x" * 5000 + "://y.com/" + "z" * 9000,
    "http://myexample.com/en/a", "http://example.com/en", "http://user@host.com:80/p",
]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = (None, None)
    for rule, verdict in urls.RULES:
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            if best[0] is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, *best


def test_rows_equal_a_plain_reading(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(ODD * 2)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    model = urls.train()
    for i, url in enumerate(ODD * 2):
        host, path, rule, verdict = plain(url)
        row = got[i]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert urls.split_url(url) == (host, path)
        slots = urls.grams(host, path)
        x = model[0][slots].sum() / max(1, len(slots)) ** 0.5 + model[1]
        assert row.verdict == (verdict or ("block" if x >= 0 else "allow"))
    assert urls.judge(pages.limit(0)).collect() == []


def test_method_judges_urls_it_has_not_seen():
    weights, bias = urls.train()
    wrong = 0
    for part in range(8):
        test = urls.LABELLED.iloc[part::8]
        weights, bias = urls.train(urls.LABELLED.drop(test.index))
        for row in test.itertuples():
            slots = urls.grams(*urls.split_url(row.url))
            wrong += (weights[slots].sum() / len(slots) ** 0.5 + bias >= 0) != bool(row.label)
    assert wrong <= 10  # of forty
    fit = [weights[s].sum() / len(s) ** 0.5 + bias for s in map(lambda u: urls.grams(*urls.split_url(u)), urls.LABELLED["url"])]
    assert ((pd.Series(fit) >= 0) == urls.LABELLED["label"].astype(bool)).mean() > 0.9


def test_table_shares_no_host_or_path_with_the_given_pages():
    import os

    import pyarrow.parquet as pq
    import pytest

    folders = [f for f in ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1") if os.path.isdir(f)]
    if not folders:
        pytest.skip("no test tables here")
    given = {urls.split_url(u) for f in folders for u in pq.read_table(f"{f}/pages.parquet", columns=["url"])["url"].to_pylist()}
    rows = [urls.split_url(u) for u in urls.LABELLED["url"]]

    def site(host):
        return ".".join(host.split(".")[-2:])

    # A site of the pages may lie below example.com: compare whole hosts and the first label.
    labels = {part for host, _ in given for part in host.split(".")[:-2] if part not in ("www", "m", "blog")}
    assert not {h for h, _ in given} & {h for h, _ in rows} and not {site(h) for h, _ in given} & {site(h) for h, _ in rows}
    assert not labels & {part for host, _ in rows for part in host.split(".") if part not in ("www", "m", "blog")}
    assert not {p for _, p in given if len(p) > 1} & {p for _, p in rows}


def held_out_by_host(labelled, folds=8):
    """Rows judged right by models that saw no row of their host, and how many there are."""
    hosts = labelled["url"].map(lambda u: urls.split_url(u)[0])
    right, fold = 0, hosts.map({h: k % folds for k, h in enumerate(sorted(set(hosts)))})
    for k in range(folds):
        weights, bias = urls.train(labelled[fold != k])
        for row in labelled[fold == k].itertuples():
            slots = urls.grams(*urls.split_url(row.url))
            right += (weights[slots].sum() / len(slots) ** 0.5 + bias >= 0) == bool(row.label)
    return right, len(labelled)


def test_accuracy_on_hosts_it_has_not_seen():
    right, count = held_out_by_host(urls.LABELLED)
    assert right >= 0.85 * count
