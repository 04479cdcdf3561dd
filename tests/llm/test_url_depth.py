"""URL templates of deep paths, in Spark and in SQL."""

import duckdb

from tastemark.llm import oracles, urls


def test_deep_segments_and_hosts_without_labels(spark):
    pages = []
    add = lambda url: pages.append((len(pages), url))
    for i in range(40):
        add(f"http://h{i % 4}.net/es/a/b/c/spam/{i}")  # blocked by the rule of its host and path
        add(f"http://other.org/es/a/b/c/spam/{i}")  # no rule and no label on the host: let through
        add(f"http://other.org/es/a/b/c/news/{i}")
    add("http://long.org/" + "/".join(f"s{i}" for i in range(60)))  # one page: no level of its own
    add("http://long.org/" + "/".join(f"s{i}" for i in range(60)))
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert len(got) == len(pages)
    for i, url in pages:
        r = got[i]
        if "other.org" in url:
            assert r["template"] == ("/es/a/b/c/spam/*" if "spam" in url else "/es/a/b/c/news/*") and r["rule"] is None
            assert r["verdict"] == "allow"
        if "long.org" in url:
            assert r["template"].endswith("/**") and r["verdict"] == "allow"
    con = duckdb.connect()
    con.register("given", df.toArrow())
    con.execute("CREATE VIEW pages AS SELECT * FROM given")
    want = {r[0]: r for r in con.execute(oracles.url_templates(depth=8)).fetchall()}
    assert {i: (r["template"], r["verdict"], round(r["purity"], 9)) for i, r in got.items()} == {i: (r[5], r[4], round(r[6], 9)) for i, r in want.items()}
