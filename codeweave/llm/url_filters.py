"""URL filters: fixed rules first, then a tree of path templates judged by labelled purity. DataFrame operations only.

Per host the tree is grown one path segment at a time. At a node, a child segment stays a literal if it has at
least MIN_ROWS urls and MIN_SHARE of the node's, or if a two-proportion test tells its bad share from the rest of the
node's, however many such children there are; only the others are variable and become `*`. The test takes LEAST_LABELS
labels, the fewest with which a template can be rejected. The children of MIN_SHARE (1 / MIN_SHARE a node at most) and `*`, in order of their share of bad pages, are merged with the
group before where the test can't tell a child from all the group's labels together, so differing ends of a chain don't
meet; unlabelled children merge with each other only. Merged literals read `{a|b}`, and what is merged with `*` is `*`.
The small ones that differ stand alone, so no node is gathered. The first DEPTH
segments are always written out. Past them the tree goes on, level by level, at every node of several paths whose labels
are mixed, and a template is written out to the last level that divided its node; what is left of it reads `**`. A
template is rejected if its smoothed share of bad labels, (bad + A) / (labelled + A + B), is at least REJECT.

All counts are pre-aggregated by (host, template, segment). The maps from segments to labels hold literals only; they are
broadcast if counted to be small, else joined by shuffle, where AQE splits a host that has a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise

#: Fixed rules of the contract: verdict, host, path prefix.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEPTH, MIN_ROWS, MIN_SHARE = 4, 5, 0.05
CHI2 = 3.84
A, B, REJECT = 1.0, 3.0, 0.5
LEAST_LABELS = (REJECT * (A + B) - A) / (1 - REJECT)
MAX_MAP_ROWS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, own + prefix).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _apart(labelled: str, bad: str, other_labelled: str, other_bad: str) -> str:
    """SQL of the two-proportion test; false where a side has no labels, null where it has no row."""
    p = f"(({bad} + {other_bad}) / ({labelled} + {other_labelled}))"
    differ = f"power({bad} / {labelled} - {other_bad} / {other_labelled}, 2) > {CHI2} * {p} * (1 - {p}) * (1.0 / {labelled} + 1.0 / {other_labelled})"
    return f"if({labelled} = 0 or {other_labelled} = 0, false, {differ})"


_GROUPS = "array<struct<labelled:bigint,bad:bigint,star:boolean,segments:array<string>>>"
#: SQL of the merge: children in order, each to the group before if its labels can't be told from the group's, else to a new one.
_POOLED = f"""aggregate(kids, cast(array() as {_GROUPS}), (groups, x) -> case
    when size(groups) = 0 or (element_at(groups, -1).labelled = 0) <> (x.labelled = 0) or {_apart("x.labelled", "x.bad", "element_at(groups, -1).labelled", "element_at(groups, -1).bad")}
    then concat(groups, cast(array(struct(x.labelled, x.bad, x.star, array(x.segment))) as {_GROUPS}))
    else concat(slice(groups, 1, size(groups) - 1), cast(array(struct(element_at(groups, -1).labelled + x.labelled, element_at(groups, -1).bad + x.bad,
        element_at(groups, -1).star or x.star, concat(element_at(groups, -1).segments, array(x.segment)))) as {_GROUPS})) end)"""


def _labels(stat: DataFrame) -> DataFrame:
    """(host, template, segment, label) of the literal children whose label isn't `*`, from their counts."""
    node = ["host", "template"]
    total = stat.groupBy(*node).agg(F.sum("n").alias("total"), F.sum("labelled").alias("all_l"), F.sum("bad").alias("all_b"))
    literal = stat.join(bounded_broadcast(total, MAX_MAP_ROWS), node).withColumn("large", (F.col("n") >= MIN_ROWS) & (F.col("n") >= MIN_SHARE * F.col("total")))
    literal = literal.filter(F.col("large") | (F.col("labelled") >= LEAST_LABELS) & F.expr(_apart("labelled", "bad", "(all_l - labelled)", "(all_b - bad)"))).drop("total", "all_l", "all_b")
    # what is left of a node is its variable branch
    own = literal.groupBy(*node).agg(F.sum("labelled").alias("own_l"), F.sum("bad").alias("own_b"), F.sum("n").alias("own_n"))
    star = stat.groupBy(*node).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.sum("n").alias("t")).join(own, node)
    star = star.filter("t > own_n").select(*node, F.lit("*").alias("segment"), (F.col("t") - F.col("own_n")).alias("n"), (F.col("l") - F.col("own_l")).alias("labelled"), (F.col("b") - F.col("own_b")).alias("bad"), F.lit(True).alias("star"))
    kids = literal.filter("large").select(*node, "segment", "n", "labelled", "bad", F.lit(False).alias("star")).union(star)
    kids = kids.withColumn("share", F.expr("coalesce(bad / nullif(labelled, 0), -1.0)"))
    # a node has 1 / MIN_SHARE + 1 such children at most
    kids = kids.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct("share", "star", "segment", "labelled", "bad"))).alias("kids"))
    kids = kids.select(*node, F.explode(F.expr(_POOLED)).alias("g")).filter("not g.star").select(*node, F.sort_array("g.segments").alias("segments"))
    kids = kids.withColumn("label", F.expr("if(size(segments) = 1, segments[0], concat('{', array_join(segments, '|'), '}'))"))
    alone = literal.filter("not large").select(*node, "segment", F.col("segment").alias("label"))
    return kids.select(*node, F.explode("segments").alias("segment"), "label").union(alone)


def _next_level(paths: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """paths with their segment at the level and its label (null for `*`), and the nodes, with whether they have several labels."""
    at = paths.withColumn("segment", F.expr(f"try_element_at(segments, {level})"))
    stat = at.filter("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    stat = materialise(stat, "urls-stat")
    known = bounded_broadcast(materialise(_labels(stat), "urls-labels"), MAX_MAP_ROWS)
    label = F.coalesce("label", F.lit("*"))
    nodes = stat.join(known, ["host", "template", "segment"], "left").groupBy("host", "template").agg((F.min(label) != F.max(label)).alias("divided"))
    return at.join(known, ["host", "template", "segment"], "left"), nodes


def _deeper(paths: DataFrame, level: int, longest: int) -> DataFrame:
    """paths with `shown`, the template to the last level that divided its node, and `written`, that level.

    Each round takes the nodes that labels may still divide: several paths that go on, some labels bad and some not.
    """
    done = []
    while level < longest:
        level += 1
        node = paths.filter(F.size("segments") >= level).groupBy("host", "template").agg(F.count("*").alias("own"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        node = node.filter("own > 1 and b > 0 and b < l").select("host", "template", F.lit(True).alias("open"))
        now = paths.join(bounded_broadcast(node, MAX_MAP_ROWS), ["host", "template"], "left")
        now = materialise(now.withColumn("open", F.col("open").isNotNull() & (F.size("segments") >= level)), "urls-deeper")
        done.append(now.filter("not open").drop("open"))
        paths = now.filter("open").drop("open")
        if paths.isEmpty():
            break
        at, nodes = _next_level(paths, level)
        at = at.join(bounded_broadcast(nodes.filter("divided"), MAX_MAP_ROWS), ["host", "template"], "left")
        at = at.withColumn("template", F.expr("concat(template, '/', coalesce(label, '*'))"))
        at = at.withColumn("shown", F.expr("if(divided, template, shown)")).withColumn("written", F.expr(f"if(divided, {level}, written)"))
        paths = at.drop("segment", "label", "divided")
    for part in done:
        paths = paths.unionByName(part)
    return paths


def template_tree(pages: DataFrame, labels: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(templates, judged): judged has page_id, host, path, template; templates has host, template, n, labelled, bad, purity, rejected.

    pages: page_id, url. labels: page_id, bad (0/1); nulls don't count, a page labelled twice counts its highest label.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = materialise(rows.join(known, "page_id", "left"), "urls-rows")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = paths.filter("host <> ''").withColumn("segments", F.expr("filter(split(path, '/'), s -> s <> '')")).withColumn("template", F.lit(""))
    paths = materialise(paths, "urls-paths")
    longest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, depth + 1):
        at, _ = _next_level(paths, level)
        paths = at.withColumn("template", F.expr("if(segment is null, template, concat(template, '/', coalesce(label, '*')))")).drop("segment", "label")
    paths = paths.withColumn("shown", F.col("template")).withColumn("written", F.lit(depth))
    paths = _deeper(paths, depth, longest) if longest > depth else paths
    paths = paths.withColumn("template", F.expr("concat(shown, if(size(segments) > written, '/**', ''), if(endswith(path, '/') or path = '', '/', ''))"))
    paths = materialise(paths.select("host", "path", "template", "n", "labelled", "bad"), "urls-templates")
    templates = paths.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    templates = templates.withColumn("purity", (F.col("bad") + A) / (F.col("labelled") + A + B)).withColumn("rejected", F.col("purity") >= REJECT)
    return templates, rows.select("page_id", "host", "path").join(paths.select("host", "path", "template"), ["host", "path"], "left")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of each row of pages.

    A rule's verdict holds; elsewhere `block` if the url's template is rejected, else `allow`. Urls that are null or have no
    `://` have empty host and path, no template, and are allowed. Repeated rows are judged each; other columns are ignored.
    """
    templates, judged = template_tree(pages, labels)
    rejected = templates.filter("rejected").select("host", "template", F.lit(True).alias("rejected"))
    judged = judged.join(bounded_broadcast(rejected, MAX_MAP_ROWS), ["host", "template"], "left")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template")
