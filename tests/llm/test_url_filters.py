import os
from collections import defaultdict

import pytest
from codeweave.llm import queries
from codeweave.llm import url_filters as U
from pyspark.sql import functions as F


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "t", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, template string, n int")


def brute_templates(paths, depth):
    """paths: (host, path) -> (n, labelled, bad); returns (host, path) -> template, by the rules in plain Python."""
    state = {k: ("", [s for s in k[1].split("/") if s]) for k in paths}
    for level in range(depth):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for k, (template, segs) in state.items():
            if len(segs) > level:
                for j in range(3):
                    nodes[(k[0], template)][segs[level]][j] += paths[k][j]
        labels = {}
        for node, kids in nodes.items():
            total = sum(v[0] for v in kids.values())
            apart = lambda a, b: bool(a[1] and b[1]) and (b[2] / b[1] - a[2] / a[1]) ** 2 > U.CHI2 * (q := (a[2] + b[2]) / (a[1] + b[1])) * (1 - q) * (1 / b[1] + 1 / a[1])
            rest_of = lambda v: [sum(k[j] for k in kids.values()) - v[j] for j in range(3)]
            large = {s for s, v in kids.items() if v[0] >= U.MIN_ROWS and v[0] >= U.MIN_SHARE * total}
            literal = {s: v for s, v in kids.items() if s in large or (v[1] >= U.LEAST_LABELS and apart(v, rest_of(v)))}
            rest = [v for s, v in kids.items() if s not in literal]
            rows = [(s, v, False) for s, v in literal.items() if s in large]
            for s in literal.keys() - large:
                labels[(*node, s)] = s
            if rest and literal:
                rows.append(("*", [sum(v[j] for v in rest) for j in range(3)], True))
            rows.sort(key=lambda r: (r[1][2] / r[1][1] if r[1][1] else -1.0, r[2], r[0]))
            groups, pooled = [], []
            for r in rows:
                if groups and bool(pooled[1]) == bool(r[1][1]) and not apart(pooled, r[1]):
                    groups[-1].append(r)
                    pooled = [x + y for x, y in zip(pooled, r[1], strict=True)]
                else:
                    groups.append([r])
                    pooled = list(r[1])
            for g in groups:
                if not any(star for *_, star in g):
                    names = sorted(s for s, *_ in g)
                    for s in names:
                        labels[(*node, s)] = names[0] if len(names) == 1 else "{" + "|".join(names) + "}"
        for k, (template, segs) in list(state.items()):
            if len(segs) > level:
                state[k] = (template + "/" + labels.get((k[0], template, segs[level]), "*"), segs)
    return {k: t + ("/**" if len(s) > depth else "") + ("/" if k[1].endswith("/") or not k[1] else "") for k, (t, s) in state.items()}


def test_against_brute_force(spark):
    import random

    r = random.Random(8)
    urls = []
    for i in range(1500):
        host = "hot.example.org" if i % 3 else f"h{r.randint(0, 6)}.org"
        kind = r.choice(["spam", "news", "shop", "blog"])
        urls.append(f"https://{host}/{kind}/{r.choice(['a', 'b', str(i)])}/{i % 9}" + r.choice(["", "/", "/deep/er/x", "?q=1"]))
    urls += [None, "nothing", "http://x.org", "http://x.org/", "ftp://U@X.org:21/A/b", "http:///p"]
    labels = [(i, int("spam" in (u or "") and i % 10 > 0)) for i, u in enumerate(urls) if i % 2]
    found = {x.page_id: x for x in U.judge_urls(pages(spark, urls).repartition(3), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert len(found) == len(urls)
    counts, known = defaultdict(lambda: [0, 0, 0]), dict(labels)
    for i in range(len(urls)):
        if found[i].host:
            c = counts[(found[i].host, found[i].path)]
            c[0] += 1
            c[1] += i in known
            c[2] += known.get(i, 0)
    templates = brute_templates(dict(counts), U.DEPTH)
    judged = defaultdict(lambda: [0, 0])
    for k, (_, labelled, bad) in counts.items():
        judged[(k[0], templates[k])][0] += labelled
        judged[(k[0], templates[k])][1] += bad
    for i in range(len(urls)):
        f = found[i]
        template = templates.get((f.host, f.path)) if f.host else None
        assert f.template == template
        bad = judged[(f.host, template)] if f.host else (0, 0)
        method = "block" if f.host and (bad[1] + U.A) / (bad[0] + U.A + U.B) >= U.REJECT else "allow"
        assert f.rule is None and f.verdict == method
    assert {f.verdict for f in found.values()} == {"allow", "block"}


def test_rules(spark):
    cases = {
        "http://example.com/en/x": ("example.com/en/", "block"), "http://WWW.Example.COM/en/x": ("www.example.com/en/", "allow"), "http://a.www.example.com/en/": ("www.example.com/en/", "allow"),
        "http://m.example.com/en/": ("example.com/en/", "block"), "http://example.com/en": ("com/", "allow"), "http://com": (None, "allow"), "http://com/": ("com/", "allow"), "http://notexample.com/en/": ("com/", "allow"),
        "x://a.net/es/?y": ("net/es/", "block"), "x://a.net/fr": (None, "allow"), "x://net/fr/#z": ("net/fr/", "block"), "http://xcom/": (None, "allow"), None: (None, "allow"), "example.com/en/": (None, "allow"),
    }
    no_labels = spark.createDataFrame([], "page_id long, bad int")
    got = U.judge_urls(pages(spark, list(cases)), no_labels).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == dict(enumerate(cases.values()))
    parts = {r.page_id: (r.host, r.path) for r in got}
    assert parts[1] == ("www.example.com", "/en/x") and parts[12] == ("", "") and parts[8] == ("a.net", "/es/")


def test_empty(spark):
    assert U.judge_urls(pages(spark, []), spark.createDataFrame([], "page_id long, bad int")).count() == 0
    host, path = U.host_and_path(F.lit("a://b://c/d?e"))
    assert tuple(spark.range(1).select(host, path).first()) == ("b:", "//c/d")


def test_small_branches_of_a_large_host(spark):
    """Sixty sections of a sixtieth each, one of them bad: no share of the host hides it."""
    urls = [f"http://hot.org/s{i % 60}/p{i}" for i in range(600)]
    labels = [(i, int(i % 60 == 7)) for i in range(600) if i % 120 < 60]
    got = U.judge_urls(pages(spark, urls), spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()
    assert {r.page_id % 60 for r in got if r.verdict == "block"} == {7} and sum(r.verdict == "block" for r in got) == 10
    assert {r.template for r in got} == {"/s7/*", "/*/*"}


def test_branch_of_four(spark):
    """Four urls of two hundred, all labelled bad, are rejected by themselves."""
    urls = [f"http://hot.org/{'bad' if i < 4 else 'ok'}/p{i}" for i in range(200)]
    got = U.judge_urls(pages(spark, urls), spark.createDataFrame([(i, int(i < 4)) for i in range(200)], "page_id long, bad int"), rules=()).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {0, 1, 2, 3}


def test_branches_past_the_depth(spark):
    """Labels divide the tree at the fifth and at the seventh segment; where they don't, `**` stays."""
    urls = [f"http://x.org/a/b/c/d/{'spam' if i % 2 else 'docs'}/p{i}" for i in range(80)]
    urls += [f"http://y.org/a/b/c/d/e/f/{'spam' if i % 2 else 'docs'}/g/p{i}" for i in range(80)] + ["http://y.org/a/b/c/d/e", "http://z.org/a/b/c/d/e/f"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 160) if i % 8 < 4], "page_id long, bad int")
    got = {r.page_id: r for r in U.judge_urls(pages(spark, urls), labels, rules=()).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i in range(160) if i % 2}
    assert got[1].template == "/a/b/c/d/spam/**" and got[81].template == "/a/b/c/d/e/f/spam/**"
    assert got[160].template == "/a/b/c/d/**" and got[161].template == "/*/*/*/*/**"


def test_merging_pools_the_group(spark):
    """Sections with 0, 2, 4 and 6 bad labels of 6: neighbours are alike, the ends are not; a section without labels stays apart."""
    urls = [f"http://x.org/s{i // 6}/p{i}" for i in range(30)]
    labels = spark.createDataFrame([(i, int(i % 6 < 2 * (i // 6))) for i in range(24)], "page_id long, bad int")
    got = U.judge_urls(pages(spark, urls), labels, rules=()).collect()
    assert {r.template for r in got} == {"/{s0|s1}/*", "/{s2|s3}/*", "/s4/*"}
    assert {r.page_id // 6 for r in got if r.verdict == "block"} == {2, 3}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_query_rejects_and_keeps(spark, sf):
    """The tree decides pages both ways where no fixed rule does."""
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no test tables here")
    got = queries.op1_url_filters(spark, f"/root/testdata/{sf}").filter("rule is null and host <> ''").groupBy("verdict").agg(F.count_distinct("host", "template").alias("n")).collect()
    assert {r.verdict: r.n > 0 for r in got} == {"allow": True, "block": True}
