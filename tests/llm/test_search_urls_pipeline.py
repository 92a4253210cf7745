import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import queries as llm
from quarry.llm import topk_search, url_filter
from tests.oracle import connect, same_rows


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_against_sql(name, spark, sf_dir):
    same_rows(llm.queries()[name](spark, sf_dir), connect(sf_dir), llm.oracle_sql()[name])


def brute(rows, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(64 * np.float64(np.float32(x)))) for x in v])
    out = []
    for q in ok:
        if q % 20 == 0:
            for vec in {tuple(v) for v in ok[q]}:
                scores = [(-sum(a * b for a, b in zip(vec, v)), i) for i, vs in ok.items() if i != q for v in vs]
                out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block_queries", [(4096, 1024), (37, 2)])
def test_search_is_exact(spark, shard_rows, block_queries):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.float32(rng.standard_normal(12) / 3)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(400, 430)]  # ties
    rows += [(500, None), (520, []), (501, [None] * 12), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11), (504, [1.0] * 3), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as id", "3 as score")
    got = sorted(tuple(r) for r in topk_search.search(df, shard_rows=shard_rows, block_queries=block_queries).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)


def test_search_prunes_and_odd_tables(spark):
    rng = np.random.default_rng(3)
    values = np.floor(rng.standard_normal((500, 16)) * 10) * np.geomspace(8, 0.2, 16).round()
    shard = topk_search.Shard(np.arange(500), values)
    asked = np.arange(0, 500, 3)
    cols, rows, score = shard.top(asked, values[asked], 5)
    for n, q in enumerate(asked):
        want = sorted((-(values[i] @ values[q]), i) for i in range(500) if i != q)[:5]
        assert [(-s, i) for c, s, i in zip(cols, score, rows) if c == n] == want
    schema = "vec_id long, embedding array<float>"
    assert topk_search.search(spark.createDataFrame([], schema)).count() == 0
    assert topk_search.search(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert topk_search.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).first()["score"] == 64 * 128


def test_sparse_postings_and_floors():
    """Postings without zeros, and thresholds from elsewhere, give the best rows above them."""
    rng = np.random.default_rng(8)
    values = np.floor(rng.standard_normal((700, 40)) * 20) * (rng.random((700, 40)) < 0.08)
    values[:, 3] = np.floor(rng.random(700) * 9) + 1
    shard = topk_search.Shard(np.arange(700), values)
    assert len(shard.postings) == 39 and all((values[p, t] != 0).all() and len(p) == np.count_nonzero(values[:, t]) for t, p in shard.postings.items())
    asked = np.arange(0, 700, 9)
    queries = values[asked] * (rng.random((len(asked), 40)) < 0.5)
    score = queries @ values.T
    score[np.arange(len(asked)), asked] = -np.inf
    for floor in (None, np.sort(score, axis=1)[:, -9], np.full(len(asked), 1e9)):
        cols, rows, found = shard.top(asked, queries, 5, floor)
        for n in range(len(asked)):
            want = sorted((-s, i) for i, s in enumerate(score[n]) if s > -np.inf and (floor is None or s >= floor[n]))[:5]
            assert [(-s, i) for c, s, i in zip(cols, found, rows) if c == n] == want


@pytest.mark.parametrize("shard_rows", [4096, 7])
def test_components_of_any_size(spark, shard_rows):
    """Large components among plain ones: exact sums, also beyond 64 bits, and every vector is scored."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(3)]) for i in range(41)]
    rows += [(60, [300000.0, 1.0, -1.0]), (61, [300000.0, 1.0]), (80, [1e30, -1e30, 5.0]), (81, [-1e300, 1.0, 2.0]), (82, [1.7e308, 0.0, 0.0]), (83, [2.0**40, 2.0**40 + 0.25, 0.0]), (100, [2.0**40, 0.5, 0.0]), (84, [1e30, -1e30, 6.0])]
    whole = {i: [int(x) * 64 if abs(x) > 2**53 else int(np.floor(64 * x)) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, n + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, i) in enumerate(found)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(df, shard_rows=shard_rows, block_queries=2).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.COM/en/x", "a.com", "/en/x", "com/en/", "block"), ("http://www.example.com/en/7x", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://com/en/", "com", "/en/", "com/en/", "block"), ("http://xcom/en/", "xcom", "/en/", None, "allow"),
        ("http://a.net/de/1?x#y", "a.net", "/de/1", "net/de/", "allow"), ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("http://a.org/es", "a.org", "/es", None, "allow"), ("http://a.org?x=/es/", "a.org", "", None, "allow"), ("no scheme /en/", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://casino.example.org/", "casino.example.org", "/", None, "block"), ("http://casinos.example.org/", "casinos.example.org", "/", None, "allow"),
        ("http://x.fr/free-hot-live", "x.fr", "/free-hot-live", None, "block"), ("http://x.fr/free-free-free-hot", "x.fr", "/free-free-free-hot", None, "allow"),
        ("http://a.com#x://q/en/", "a.com", "", None, "allow"), ("http://www.example.com?u=http://b.com/en/7", "www.example.com", "", None, "allow"),
        ("http://x.org?a=ftp://y.org/es/", "x.org", "", None, "allow"), ("http://", "", "", None, "allow"), ("http:///en/", "", "/en/", None, "allow"), ("://com/en/#://x", "com", "/en/", "com/en/", "block"),
        ("http://x.fr/sex-poker", "x.fr", "/sex-poker", None, "block"), ("http://x.fr/sex/sex", "x.fr", "/sex/sex", None, "allow"), ("http://x.fr/free/hot", "x.fr", "/free/hot", None, "allow"),
        ("http://a.net/de/casino", "a.net", "/de/casino", "net/de/", "allow"), ("x://a://b.com/en/", "a:", "//b.com/en/", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "clash", "clash")], "page_id long, url string, host string, rule string")
    assert tuple(url_filter.judge_urls(df, keep=["page_id"]).first()) == (1, host, path, rule, verdict)


def test_urls_against_sql_on_random_urls(spark):
    import duckdb

    rng = random.Random(1)
    parts = ["http", "://", "/", "?", "#", "example.com", "com", "net", "org", ".", "en", "de", "es", "7", "8", "Casino", "free", "hot", "live", "sex", "-", "é", "\n"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    same_rows(url_filter.judge_urls(df, keep=["page_id"]), con, url_filter.oracle_sql())
    assert url_filter.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("soft, limit, verdict", [({"red": 5, "blue": 1}, 6, "block"), ({"red": 4, "blue": 1}, 6, "allow"), ({"red": 6}, 6, "block")])
def test_soft_terms_weigh(spark, soft, limit, verdict):
    df = spark.createDataFrame([(1, "http://x.fr/red-blue-red")], "page_id long, url string")
    assert url_filter.judge_urls(df, soft=soft, limit=limit).first()["verdict"] == verdict


def test_pipeline_against_its_parts(spark, sf_dir):
    """Each stage against what its operator decides on the stage's own input."""
    from quarry.llm import mixing, toxicity
    from tests.llm.test_dedup import near_brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, tables[-1], sf_dir).persist()
        assert out.columns == columns, name
        tables.append(out)
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert ids[4] <= ids[3] <= ids[2] <= ids[1] <= ids[0]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0").collect()}
    assert len(clean & ids[1]) >= 0.97 * len(clean & ids[0]) and len(toxic & ids[1]) <= 0.5 * len(toxic & ids[0])
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = dict(zip(*[[r[c] for r in docs.select("doc_id", "text").collect()] for c in ("doc_id", "text")]))
    assert ids[1] == {i for i, s in zip(scores, model.score(list(scores.values()))) if s < 0.5}
    rows = [(r["doc_id"], r["text"]) for r in tables[1].collect()]
    smallest = {}
    for i, t in rows:
        key = " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", t or ""))
        smallest[key] = min(i, smallest.get(key, i))
    assert ids[2] == set(smallest.values())
    near = near_brute([(r["doc_id"], r["text"]) for r in tables[2].collect()])
    assert ids[3] == {i for i, v in near.items() if v[2]}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixture(tables[3]).collect()}
    assert ids[4] == {i for i, n in taken.items() if n}
    last = corpus_pipeline.STAGES[-1][1](spark, tables[-1], sf_dir)
    assert last.filter("not round_trip").count() == 0 and last.count() == tables[-1].count()
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()
