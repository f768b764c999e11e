import random
from collections import Counter

import duckdb
from fixtures import AWKWARD, documents, saved
from pyspark.sql import functions as F

from gleaner.llm import site_lines

BLANKS = " \t\n\x0b\f\r"


def brute(rows):
    pages, held = Counter(), Counter()
    for text, host in rows:
        pages[host] += 1
        held.update({(host, x.strip(BLANKS)) for x in (text or "").split("\n") if x.strip(BLANKS)})
    out = []
    for text, host in rows:
        if text is None:
            out.append((None, 0, 0))
            continue
        lines = text.split("\n")
        n = lambda x: held[host, x.strip(BLANKS)]
        left = [x for x in lines if not (n(x) >= site_lines.MIN_PAGES and n(x) > site_lines.RATIO * pages[host])]
        out.append(("\n".join(left), len(lines), len(lines) - len(left)))
    return out


def rows():
    rng = random.Random(3)
    out = [(t, "a") for t in AWKWARD]
    for i in range(150):
        host = rng.choice(["a", "b", None, "c"])
        lines = [f"line {rng.randrange(400)}" for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3:
            lines.insert(0, f"  Menu of {host}\t")
        if rng.random() < 0.08:
            lines.append("All over")
        out.append(("\n".join(lines), host))
    return out + [("Menu of b", "b"), ("Menu of b", "b")]


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    given = rows()
    folder = saved(spark, tmp_path, documents(spark, [t for t, _ in given], [h for _, h in given]))
    got = sorted(map(tuple, site_lines.query(spark, folder).collect()))
    want = [(i, h, n, d, t) for i, ((_, h), (t, n, d)) in enumerate(zip(given, brute(given), strict=True))]
    assert got == want and any(d for *_, d, _ in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.execute(site_lines.SQL["op5_site_lines"]).fetchall()) == want


def test_stage_keeps_columns_and_counts_characters(spark):
    given = rows()
    docs = documents(spark, [t for t, _ in given], [h for _, h in given]).withColumn("host", F.lit("h")).withColumn("common", F.lit(1))
    done = site_lines.without_boilerplate(docs)
    assert done.schema.names == docs.schema.names and done.count() == len(given)
    assert all(r.n_chars == len(r.text) for r in done.collect() if r.text is not None)
    assert site_lines.without_boilerplate(docs.limit(0)).count() == 0


def test_hot_hosts_are_split_by_their_share(spark):
    given = rows()
    pages = documents(spark, [t for t, _ in given], [h for _, h in given]).select("doc_id", F.col("source").alias("host"), "text")
    for shares in (1, 4, 10, 1024):
        sizes = Counter(h for _, h in given)
        most = max(len(given) / shares, 1)
        got = {r.hot: r.parts for r in site_lines.split_hosts(pages, shares).collect()}
        assert got == {h: -int(-n // most) for h, n in sizes.items() if n > most} and len(got) <= shares
        assert all(sizes[h] / parts <= most for h, parts in got.items())
    assert site_lines.split_hosts(pages.limit(0)).count() == 0
