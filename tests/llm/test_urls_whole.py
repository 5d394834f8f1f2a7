"""Suffix statistics are counted over all labelled urls, not over the sample that the trees are fitted on."""

import random

from pyspark.sql import functions as F

from trackloom.llm import urls


def test_suffix_statistics_cover_all_urls(spark):
    rng, rows = random.Random(4), []
    for site in range(400):
        bad = site % 2
        word = rng.choice(("ads", "clicks", "banners", "bet") if bad else ("edu", "museum", "library", "news"))  # of many lengths
        rows += [f"http://{word}.site{site:03d}.example/{rng.randrange(9999)}" for _ in range(10)]
        rows += [f"http://xyz.site{site:03d}.example/{rng.randrange(9999)}" for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = urls.judge(df, sample_rows=400).where(F.col("host").startswith("xyz")).collect()
    right = sum((r.verdict == "block") == bool(int(r.host[8:11]) % 2) for r in got)
    assert len(got) == 800 and right / 800 > 0.97


def test_suffix_shares_equal_counts_by_hand(spark):
    rows = [("a.b.c.d", 1, 0), ("a.b.c.d", None, 1), ("b.c.d", 0, 1), ("d", 1, 2), ("x.d", None, 0), ("", None, 3)]
    shares, n = urls.suffix_shares(spark.createDataFrame(rows, "host string, label int, fold int"))
    got = {r.host: r for r in shares.collect()}
    share = lambda y, n: (y + urls.PRIOR * 2 / 3) / (n + urls.PRIOR)
    near = lambda a, b: abs(a - b) < 1e-12
    assert n == 3 and set(got) == {"a.b.c.d", "b.c.d", "d", "x.d", ""}
    assert near(got["x.d"].s1, share(2, 3)) and near(got["x.d"].s2, share(0, 0)) and near(got["b.c.d"].s3, share(1, 2)) and near(got["d"].s3, share(2, 3))
    assert near(got["d"].t1_2, share(1, 2)) and near(got["a.b.c.d"].t3_0, share(0, 1)) and near(got[""].s1, share(0, 0))


def spread_hosts(rng, n):
    """Hosts of every listed category, hosts of plain words, unlisted ones; bad hosts carry dashes and digits more often."""
    words = [w for group in urls.BLOCK_WORDS.values() for w in group]
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(4, 9))) for _ in range(300)]
    out = []
    for _ in range(n):
        if rng.random() < 0.3:
            host = f"{rng.choice(words)}-{rng.choice(plain)}{rng.choice(['', str(rng.randrange(99))])}.{rng.choice(['com', 'org'])}"
            out.append((f"http://{host}/{rng.randrange(9999)}?a={rng.randrange(99)}&b=1", 1))
        else:
            host = f"{rng.choice(['news.', 'blog.', 'docs.', 'www.', ''])}{rng.choice(plain)}.{rng.choice(['com', 'org'])}"
            out.append((f"http://{host}/{rng.choice(plain)}/{rng.randrange(99)}", 0))
    return out


def test_categories_left_out_of_the_labels_are_found_by_lexical_features(spark):
    rows = spread_hosts(random.Random(6), 4000)
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    for name, left_out in urls.BLOCK_WORDS.items():
        if name not in ("gambling", "advertising"):
            continue
        got = {r.page_id: r for r in urls.judge(df, block_words={k: v for k, v in urls.BLOCK_WORDS.items() if k != name}).collect()}
        hidden = [i for i in got if got[i].host.split("-")[0] in left_out]
        good = [i for i in got if not rows[i][1]]
        assert len(hidden) > 100 and sum(got[i].verdict == "block" for i in hidden) / len(hidden) > 0.9
        assert sum(got[i].verdict == "allow" for i in good) / len(good) > 0.97


def test_labels_are_a_parameter(spark):
    rows = spread_hosts(random.Random(7), 1500)
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(9999, rows[0][0]), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([(u, y) for u, y in rows[:750]] + [(rows[1][0], None), (None, 1), (rows[3][0], rows[3][1])], "url string, label int")
    got = {r.page_id: r for r in urls.judge(df, labels=labels).collect()}
    right = [(got[i].verdict == "block") == bool(y) for i, (_, y) in enumerate(rows) if i >= 750 and got[i].rule is None]
    assert len(got) == len(rows) + 2 and sum(right) / len(right) > 0.97


def test_host_path_and_rule_equal_sql(spark):
    """The parts of the contract that SQL can say, over a whole table and odd urls."""
    import duckdb

    sf = "/root/testdata/sf0.01/pages.parquet"
    odd = ["no scheme", "", "http://", "x://Net/", "http://a.NET", "http://A.net/?x://y/", "http://example.com/de", "http://WWW.Example.Com/de/#a", "http://b.org/fr/..", "http://\u00c4.org/fr/", "a://b?c/d"]
    pages = spark.read.parquet(sf).select("page_id", "url").unionByName(spark.createDataFrame([(10**9 + i, u) for i, u in enumerate([*odd, None])], "page_id long, url string"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.parsed(pages).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE TABLE p AS SELECT page_id, url FROM '{sf}'")
    db.executemany("INSERT INTO p VALUES (?, ?)", [(10**9 + i, u) for i, u in enumerate([*odd, None])])
    want = db.execute("""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM p),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
        rules AS (SELECT unnest(['net/', 'example.net/en/', 'example.com/de/', 'org/fr/']) AS rule)
        SELECT page_id, coalesce(host, ''), coalesce(path, ''), (
          SELECT arg_max(rule, length(rule)) FROM rules
          WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))))
        FROM parts""").fetchall()
    assert got == {i: (h, p, r) for i, h, p, r in want}
