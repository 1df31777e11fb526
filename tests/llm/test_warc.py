from codeweave.llm import warc as W
from pyspark.sql import functions as F

SCHEMA = "record_id long, url string, ts long, status int, headers map<string,string>, digest string, length long, slice int, place string"


def records(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)


def brute(rows, canon):
    out = {}
    for rid, url, ts, status, headers, digest, length in rows:
        headers = headers or {}
        if status == 200:
            out[rid] = ("response", rid, headers, digest)
            continue
        if status != 304:
            out[rid] = ("other", None, headers, None)
            continue
        before = [r for r in rows if r[3] == 200 and canon[r[0]] is not None and canon[r[0]] == canon[rid] and (r[2], r[0]) < (ts, rid)]
        if not before:
            out[rid] = ("missing", None, headers, None)
            continue
        s = max(before, key=lambda r: (r[2], r[0]))
        have, bare = s[4] or {}, lambda x: (x or "").removeprefix("W/")
        if "etag" in headers:
            state = "resolved" if bare(headers["etag"]) == bare(have.get("etag")) else "mismatch"
        elif "last-modified" in headers and "last-modified" in have:
            state = "resolved" if headers["last-modified"] == have["last-modified"] else "mismatch"
        else:
            state = "unchecked"
        taken = state in ("resolved", "unchecked")
        merged = {**have, **{k: v for k, v in headers.items() if k in W.PERMITTED}} if taken else headers
        out[rid] = (state, s[0] if taken else None, merged, s[5] if taken else None)
    return out


def test_against_brute_force(spark):
    import random

    r = random.Random(6)
    urls = ["http://a.com/x", "https://www.A.com/x/", "http://a.com/x?utm_q=1", "http://b.org/?b=2&a=1", "http://b.org?a=1&b=2", "nonsense", None]
    rows = []
    for i in range(600):
        h = {k: v for k, v in (("etag", r.choice(['"1"', 'W/"1"', '"2"'])), ("last-modified", r.choice("mn")), ("content-length", str(i)), ("date", str(i)), ("x", "y")) if r.random() < 0.6}
        rows.append((i, r.choice(urls) if i % 3 else urls[0], r.randint(0, 150), r.choice([200, 304, 304, 404, None]), h if r.random() < 0.95 else None, f"d{i}", i))
    df = records(spark, rows)
    canon = {x.record_id: x.c for x in df.select("record_id", W.canonical_url(F.col("url")).alias("c")).collect()}
    for slices in (64, 2, None):
        got = {x.record_id: (x.outcome, x.source_id, x.headers, x.digest) for x in W.resolve_revisits(df.repartition(3), slices).collect()}
        assert got == brute(rows, canon)
    assert {v[0] for v in got.values()} == {"response", "other", "missing", "resolved", "mismatch", "unchecked"}


def test_equal_times_and_clashing_columns(spark):
    """All records at one time are cut by record_id; columns named as the operator's own change nothing."""
    rows = [(i, "http://a.com/x", 5, 200 if i % 10 == 0 else 304, {"etag": '"1"'}, f"d{i}", i) for i in range(300)]
    df = records(spark, rows).selectExpr("*", "'c' as canonical_url", "1 as near", "2 as far", "3 as full", "4 as source", "5 as outcome", "6 as taken", "7 as source_id")
    got = {x.record_id: x.source_id for x in W.resolve_revisits(df, 16).collect()}
    assert got == {i: i // 10 * 10 for i in range(300)}


def test_canonical_urls(spark):
    cases = {
        "HTTP://User:p@WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#frag": "example.com/a/b?a=1&b=2", "https://example.com": "example.com", "https://example.com:8443/": "example.com:8443",
        "no scheme": None, None: None, "http:///path": None, "http://h/p?": "h/p", "http://h/p?reference=1&ref=2": "h/p?reference=1",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", W.canonical_url(F.col("url")).alias("c"))
    assert {r.url: r.c for r in df.collect()} == cases


def test_empty_and_repeated(spark):
    assert W.resolve_revisits(records(spark, [])).count() == 0
    row = (1, "http://a/x", 5, 304, None, None, None)
    assert W.resolve_revisits(records(spark, [row, row, (None, None, None, None, None, None, None)])).count() == 3
    payload = spark.createDataFrame([(1, "body")], "record_id long, payload string")
    full = (1, "http://a/x", 1, 200, {}, "d", 4)
    got = W.attach_payloads(W.resolve_revisits(records(spark, [full, (2, "http://a/x", 5, 304, {}, None, None)])), payload).collect()
    assert {r.record_id: r.payload for r in got} == {1: "body", 2: "body"}
