"""The best candidates of many anchors by token sets, without scoring all pairs.

With n of an anchor's na tokens in common a candidate scores n / na at most, since the union is at least na large. So an anchor meets the
candidates by its rarest tokens first; those not met yet share only the tokens that are left, and once the k-th best score is
above what these can give, the anchor is done (MaxScore). Rounds double the number of tokens that are looked at. Equal token
sets are one set on either side: a set of candidates is known by its least members, a set of anchors is solved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import discard, materialise, stored

#: Scores are compared with bounds up to this.
SLACK = 1e-9


def _sets(df: DataFrame, key: str) -> DataFrame:
    """(key, tokens as sorted hashes, set): equal sets have an equal number."""
    hashed = F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t)))
    return df.select(key, F.coalesce(hashed, F.array().cast("array<long>")).alias("tokens")).withColumn("set", F.xxhash64("tokens", F.size("tokens")))


def _rounded(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)


def best_sets(anchors: DataFrame, candidates: DataFrame, members: DataFrame, n: int, weights: tuple[float, float], digits: int | None, least: float) -> tuple[DataFrame, int]:
    """((aset, set, score) of the n best candidate sets with a common token for each anchor set, pairs of sets that were scored).

    anchors (aset, tokens), candidates (set, tokens): distinct sets of token hashes; members (set, least, many): the least member and the number of members,
    n at most. Equal scores go by least member.
    """
    spark = anchors.sparkSession
    j, o = weights
    postings = candidates.select("set", F.size("tokens").alias("nb"), F.explode("tokens").alias("token"))
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    tokens = anchors.select("aset", F.size("tokens").alias("na"), F.explode("tokens").alias("token")).join(df, "token")
    # a set's tokens by rarity; those that no candidate has can't be shared
    plan = materialise(tokens.selectExpr("aset", "na", "token", "row_number() over (partition by aset order by df, token) - 1 as pos", "count(*) over (partition by aset) as known"), "topk-plan")
    open_ = plan.filter("pos = 0").select("aset", F.lit(least).cast("double").alias("kth"))
    best, best_path, seen, scored_pairs = None, None, [], 0
    at, to = 0, 1
    while True:
        probes = plan.filter(F.col("pos").between(at, to - 1)).join(open_, "aset")
        shared = F.least(F.col("known") - F.col("pos"), F.col("nb").cast("long"))
        most = _rounded(j * shared / (F.col("na") + F.col("nb") - shared) + o * shared / F.col("na") + SLACK, digits)
        pairs = probes.join(postings, "token").filter(most >= F.col("kth")).select("aset", "set").distinct()
        for before in seen:
            pairs = pairs.join(before.select("aset", "set"), ["aset", "set"], "left_anti")
        both = pairs.join(anchors.select("aset", F.col("tokens").alias("ta")), "aset").join(candidates.select("set", F.col("tokens").alias("tb")), "set")
        both = both.select("aset", "set", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("n"))
        score = _rounded(j * (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))) + o * (F.col("n") / F.col("na")), digits)
        seen.append(materialise(both.select("aset", "set", score.alias("score")), "topk-scored"))
        scored_pairs += seen[-1].count()
        found = seen[-1].filter(F.col("score") >= least).join(members, "set")
        found = found if best is None else found.unionByName(best)
        w = Window.partitionBy("aset").orderBy(F.desc("score"), "least")
        last, (best, best_path) = best_path, stored(found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("place"), "topk-best")
        if last:
            discard(spark, last)
        so_far = Window.partitionBy("aset").orderBy(F.desc("score"), "least").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kth = best.withColumn("sum", F.sum("many").over(so_far)).filter(F.col("sum") >= n).groupBy("aset").agg(F.max("score").alias("kth"))
        left = plan.filter(F.col("pos") == to).select("aset", _rounded((F.col("known") - F.col("pos")) / F.col("na") + SLACK, digits).alias("most"))
        left = left.join(open_.select("aset"), "aset").join(kth, "aset", "left").withColumn("kth", F.coalesce("kth", F.lit(least).cast("double")))
        # a bound that equals the k-th score may still bring a lesser member
        open_ = materialise(left.filter("most >= kth").select("aset", "kth"), "topk-open")
        at, to = to, 2 * to
        if open_.isEmpty():
            return best, scored_pairs


def top_by_token_sets(anchors: DataFrame, candidates: DataFrame, n: int, weights: tuple[float, float], digits: int | None = 4, least: float = 0.0, fill: bool = True) -> DataFrame:
    """(anchor_id, record_id, sim_score, rank): the n best candidates (record_id, tokens) of each anchor (anchor_id, tokens).

    Scores are rounded to `digits` (None: not at all); equal ones go by record_id, which must be unique. Scores under `least` don't
    count. fill: candidates without a common token, of score 0, fill up by record_id. Token lists must be free of repeats; they
    are compared by 64-bit hashes. A null or empty list has nothing in common with any.
    """
    a, c = materialise(_sets(anchors, "anchor_id"), "topk-anchors").withColumnRenamed("set", "aset"), materialise(_sets(candidates, "record_id"), "topk-candidates")
    # the least n members of a set are all that can be needed of it
    kept = c.withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy("record_id"))).filter(F.col("place") <= n)
    kept = materialise(kept.select("set", "record_id"), "topk-members")
    members = kept.groupBy("set").agg(F.min("record_id").alias("least"), F.count("*").alias("many"))
    distinct = lambda df, key: df.groupBy(key).agg(F.first("tokens").alias("tokens"))
    a_sets = materialise(distinct(a, "aset"), "topk-anchor-sets")
    c_sets = materialise(distinct(c, "set"), "topk-candidate-sets")
    best, _ = best_sets(a_sets, c_sets, members, n, weights, digits, least)
    w = Window.partitionBy("aset").orderBy(F.desc("sim_score"), "record_id")
    found = best.filter("score > 0").join(kept, "set").select("aset", "record_id", F.col("score").alias("sim_score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    if fill:
        have = a_sets.select("aset").join(found.groupBy("aset").agg(F.collect_list("record_id").alias("have")), "aset", "left").withColumn("have", F.coalesce("have", F.array().cast(f"array<{candidates.schema['record_id'].dataType.simpleString()}>")))
        first = c.select("record_id").orderBy("record_id").limit(2 * n).agg(F.array_sort(F.collect_list("record_id")).alias("first"))  # one row
        short = have.filter(F.size("have") < n).join(F.broadcast(first), how="cross")
        rest = short.select("aset", F.size("have").alias("s"), F.posexplode(F.slice(F.array_except("first", "have"), F.lit(1), F.lit(n) - F.size("have"))).alias("i", "record_id"))
        found = found.unionByName(rest.select("aset", "record_id", F.lit(0.0).alias("sim_score"), (F.col("s") + F.col("i") + 1).cast("int").alias("rank")))
    return a.select("anchor_id", "aset").join(found, "aset").select("anchor_id", "record_id", "sim_score", "rank")
