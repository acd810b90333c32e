from tessella.llm import urls

RULES = [urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"), urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block")]


def judge(spark, pages, listed=(), **how):
    p = spark.createDataFrame(pages, "page_id long, url string, host string, block int")
    return {r["page_id"]: r for r in urls.filter_urls(p, spark.createDataFrame([(u,) for u in listed], "url string"), RULES, **how).collect()}


def test_rules_and_parts(spark):
    got = judge(spark, [(i, u, "clash", 0) for i, u in enumerate(["HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://a.com/fr/1", "http://a.com/de/1", "http://a.net/de/1", None, "no-scheme/x", "http://notexample.org.evil/es/", "x://a.org", "u://ÄB.org/y"])])
    assert [got[i]["rule"] for i in range(11)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, "org/"]
    assert got[0]["host"] == "www.example.org" and got[0]["path"] == "/es/x"
    assert got[10]["host"] == "Äb.org"
    assert (got[6]["host"], got[6]["path"], got[6]["verdict"]) == ("", "", "allow")
    assert got[9]["path"] == ""


def test_bloom_has_no_false_negative_and_join_no_false_positive(spark):
    listed = [f"http://bad{i}.net/p" for i in range(300)]
    pages = [(i, f"https://www.bad{i}.net/p/?utm_source=x#f", "c", 1) for i in range(0, 600)]
    for n_blocks in (None, 1, 4, 65536, (1 << 18) + 1):  # one block lets nearly everything through: the join still decides
        got = judge(spark, pages, listed, n_blocks=n_blocks)
        assert {i for i, r in got.items() if r["listed"]} == set(range(300))
        assert all(got[i]["possible"] for i in range(300))
        assert all((r["verdict"] == "block") == r["listed"] for r in got.values())
    assert sum(r["possible"] for r in got.values()) < 330


def test_empty_and_repeated(spark):
    assert judge(spark, []) == {}
    p = spark.createDataFrame([(1, "http://x.net/a", "c", 1)] * 3, "page_id long, url string, host string, block int")
    rows = urls.filter_urls(p, p, RULES).collect()
    assert len(rows) == 3 and all(r["listed"] for r in rows)


def test_query_blocks_by_canonical_form_only(spark, tmp_path):
    """The query's list is written in another form than the pages; a plain Bloom filter and set decide the same."""
    from tessella.llm.queries import op1

    forms = ["http://m.casino-win.example.net/en/{0}.html", "https://www.casino-win.example.net/en/{0}/", "http://ok.example.net/en/{0}?b=2&a=1&utm_source=x", "https://spam-farm.example.net/{0}?page=2&ref=x#top", "http://spam-farm.example.net:80/{0}?page=2"]
    pages = [(n, f.format(n // 7), "clash") for n, f in enumerate(forms * 20)]
    spark.createDataFrame([*pages, (None, None, "x")], "page_id long, url string, listed string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in op1(spark, str(tmp_path)).collect()}
    assert got == {n: "block" if "casino-win" in u or "spam-farm" in u else "allow" for n, u, _ in pages} | {None: "allow"}
