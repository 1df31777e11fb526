"""Linking equivalent codes across provinces: pairs within a category, greedy groups of one code a province, keys."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from . import blocks
from .graph import connected_components, discard, materialise, stored
from .records import numbered

#: Least score of two records with tokens, and of others; score of two records without tokens.
NEAR, LEAST, BOTH_EMPTY = 0.55, 0.03, 0.05
NO_CATEGORY = "NOMAP"


def bucket_of(category: Column) -> Column:
    return F.coalesce(text.nonblank(category), F.lit(NO_CATEGORY))


def _equal_pairs(r: DataFrame, every: bool, by: Sequence[str] = ()) -> DataFrame:
    """(bucket, *by, lp, rp, left_id, right_id) of records without tokens, or with equal sets by `by`: every pair, or only those of the same rank in their provinces.

    The fold that builds groups takes the i-th such record of each province together, so it needs no others: records without
    tokens have no other pairs, and equal sets the highest score, so that their pairs come before all others.
    """
    own = r.select("bucket", *by, "place", "record_id")
    keys = ["bucket", *by]
    if not every:
        own, keys = numbered(own, [*keys, "place"], ["record_id"], "i"), [*keys, "i"]
    pairs = own.withColumnsRenamed({"place": "lp", "record_id": "left_id"}).join(own.withColumnsRenamed({"place": "rp", "record_id": "right_id"}), keys)
    return pairs.filter("lp < rp").select("bucket", *by, "lp", "rp", "left_id", "right_id")


def bucket_pairs(records: DataFrame, near: float = NEAR, both_empty: float = BOTH_EMPTY, every_blank: bool = True) -> DataFrame:
    """(bucket, left_id, right_id, prov_pair, score): pairs of different provinces of one bucket whose score reaches its threshold.

    records: record_id, province, bucket, tokens (distinct). The left province of a pair is the one that comes first in the
    bucket by record_id; prov_pair numbers the pairs of provinces in that order. Since the score is at most the share of the left
    set, a pair needs ceil(near * n) common tokens: the left side meets the right by its n - ceil(near * n) + 1 rarest tokens
    only, and pairs that share one are scored on the whole sets. Pairs of records without tokens meet by bucket, province first.
    """
    r = records.filter(F.col("bucket") != NO_CATEGORY)
    first = r.groupBy("bucket", "province").agg(F.min("record_id").alias("first"))
    place = first.selectExpr("bucket", "province", "row_number() over (partition by bucket order by first) as place", "count(*) over (partition by bucket) as provinces")
    r = r.join(place.filter("provinces > 1"), ["bucket", "province"])
    words = r.filter("size(tokens) > 0").select("bucket", "place", "record_id", "tokens", F.explode("tokens").alias("token"))
    narrow = words.select("bucket", "place", "record_id", F.size("tokens").alias("n"), "token")
    df = narrow.groupBy("bucket", "token").agg(F.count("*").alias("df"))
    ranked = narrow.join(df, ["bucket", "token"]).groupBy("bucket", "place", "record_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    left = ranked.select("bucket", F.col("place").alias("lp"), F.col("record_id").alias("left_id"), F.explode(F.expr(f"slice(t.token, 1, n - cast(ceil({near} * n - 1e-9) as int) + 1)")).alias("token"))
    right = narrow.select("bucket", F.col("place").alias("rp"), F.col("record_id").alias("right_id"), "token")
    pairs = left.join(right, ["bucket", "token"]).filter("lp < rp").select("bucket", "lp", "rp", "left_id", "right_id").distinct()
    sets = r.select("record_id", "tokens")
    pairs = pairs.join(sets.select(F.col("record_id").alias("left_id"), F.col("tokens").alias("lt")), "left_id").join(sets.select(F.col("record_id").alias("right_id"), F.col("tokens").alias("rt")), "right_id")
    scored = pairs.withColumn("score", scores.token_score(F.col("lt"), F.col("rt"))).filter(F.col("score") >= near)
    blank = _equal_pairs(r.filter("size(tokens) = 0"), every_blank)
    pair = F.format_string("%06d-%06d", "lp", "rp").alias("prov_pair")
    out = ["bucket", "left_id", "right_id", pair]
    return scored.select(*out, "score").union(blank.select(*out, F.lit(both_empty).alias("score")))


_BLOCK = ["bucket", "place", "province", "block"]
_PACKED = f"bucket string, place int, province string, block int, least int, most int, {blocks.PACKED}"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
#: Tokens that a task packs at a time.
PACK_TOKENS = 8_000_000


def _packed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One packed row for each block of the records that a task reads, so many tokens at a time."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        held.append(batch)
        weight += len(batch["tokens"].flatten())
        if weight >= PACK_TOKENS:
            yield from _packed_rows(held)
            held, weight = [], 0
    if held:
        yield from _packed_rows(held)


def _packed_rows(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records = pa.Table.from_batches(batches)
    if not records.num_rows:
        return
    ids, tokens = records["record_id"].to_numpy(), records["tokens"].combine_chunks()
    starts, values = tokens.offsets.to_numpy().astype(np.int64), tokens.values.to_numpy()
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, _PACKED.split(", "))])
    for key, at in records.select(_BLOCK).to_pandas().groupby(_BLOCK, sort=False).indices.items():
        sizes = starts[at + 1] - starts[at]
        bounds = {"least": int(sizes.min()), "most": int(sizes.max())}
        row = dict(zip(_BLOCK, key, strict=True)) | bounds | blocks.packed(ids[at], sizes, values[blocks.ranges(starts[at], sizes)])
        yield pa.RecordBatch.from_pylist([row], schema)


def _merged_block(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    bounds = {"least": parts["least"].min(), "most": parts["most"].max()}
    return pd.DataFrame([dict(zip(_BLOCK, key, strict=True)) | bounds | blocks.merged(parts.to_dict("records"))])


_FOUND = "bucket string, left_id long, right_id long, prov_pair string, score double, left_prov string, right_prov string"


def _set_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, place, record_id, n, h): size and hash of the sets of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            block = blocks.Block(row)
            n = len(block.ids)
            yield pa.record_batch([pa.repeat(row["bucket"], n), pa.repeat(pa.scalar(row["place"], pa.int32()), n), block.ids, block.sizes.astype(np.int32), block.hashes()], names=["bucket", "place", "record_id", "n", "h"])


def _block_pairs(near: float, equal: bool):
    """Pairs that reach `near` of the two blocks l and r of each row, with or without those of equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                both = batch.slice(i, 1).to_pylist()[0]
                left, right = both["l"], both["r"]
                # a left block comes with one right block after the other
                if key != (key := tuple(left[c] for c in _BLOCK)):
                    x = blocks.Block(left)
                y = blocks.Block(right)
                pair = f"{left['place']:06d}-{right['place']:06d}"
                for a, b, score in blocks.met(x, y, near, scores.LOOKUP, equal):
                    bucket, prov_pair, *provinces = (pa.repeat(pa.scalar(v, pa.string()), len(a)) for v in (left["bucket"], pair, left["province"], right["province"]))
                    found = pa.table([bucket, x.ids[a], y.ids[b], prov_pair, score, *provinces], names=[c.split()[0] for c in _FOUND.split(", ")])
                    yield from found.to_batches(max_chunksize=1 << 16)

    return run


#: Up to so many sizes of sets, or provinces of buckets, go to the tasks that read records.
MAP_SIZES = 200_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAP_SIZES else df


#: Weight of a block (its tokens, and SET_WEIGHT for each record), at least and at most; between them all blocks are so many.
LEAST_BLOCK, MOST_BLOCK, BLOCKS, SET_WEIGHT = 500_000, 6_000_000, 24, 64


def bucket_pairs_dense(records: DataFrame, near: float = NEAR, both_empty: float = BOTH_EMPTY, block: int | None = None, every_blank: bool = True) -> DataFrame:
    """bucket_pairs, with left_prov and right_prov, for buckets in which most pairs share tokens: blocks of both sides meet in a task.

    Blocks hold records of one bucket and province of neighbouring sizes, up to a weight (block, else a share of the whole weight); each is one
    packed row (see blocks) of a stored table. The tasks that read records pack what they have of each block, so that token sets are
    shuffled packed, and parts are merged. Two blocks of different provinces whose sizes can reach `near` meet in the task
    that reads them both, so blocks aren't copied to each other through a shuffle. Tokens are compared as 64-bit hashes, and so are sets
    of one size within a block, of which equal ones are compared once. Without every_blank, equal sets too have only pairs of the same rank.
    """
    r = records.filter(F.col("bucket") != NO_CATEGORY)
    # stored, since what follows needs little of a record twice: what is counted to be small of these is broadcast, so tokens meet it where they are read
    sets = materialise(r.select("bucket", "province", "record_id", F.size("tokens").alias("n")), "link-sets")
    first = sets.groupBy("bucket", "province").agg(F.min("record_id").alias("first"))
    place = first.selectExpr("bucket", "province", "row_number() over (partition by bucket order by first) as place", "count(*) over (partition by bucket) as provinces")
    place = materialise(place.filter("provinces > 1").drop("provinces"), "link-places")
    sets = sets.join(place, ["bucket", "province"])
    full = r.join(_few(place), ["bucket", "province"]).select("bucket", "place", "province", "record_id", F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    sizes = sets.filter("n > 0").groupBy("bucket", "place", "n").agg((F.count("*") * (F.col("n") + SET_WEIGHT)).alias("weight"))
    if block is None:
        whole = sizes.agg(F.sum("weight")).first()[0] or 0
        block = min(max(whole // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
    # a row for each size of a bucket and province: the blocks that its records are dealt to
    upto = "sum(weight) over (partition by bucket, place order by n)"
    dealt = materialise(sizes.selectExpr("bucket", "place", "n", f"cast(floor(({upto} - weight) / {block}) as int) as from_block", f"cast(floor(({upto} - 1) / {block}) as int) as to_block"), "link-sizes")
    placed = full.join(_few(dealt), ["bucket", "place", "n"]).withColumn("block", F.col("from_block") + F.pmod(F.xxhash64("record_id"), F.col("to_block") - F.col("from_block") + 1).cast("int"))
    parts = placed.select(*_BLOCK, "record_id", "tokens").mapInArrow(_packed_parts, _PACKED)
    packed = materialise(parts.groupBy(_BLOCK).applyInPandas(_merged_block, _PACKED), "link-blocks")
    l, r = (packed.select(F.struct("*").alias(side)) for side in "lr")  # noqa: E741
    meets = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.place") < F.col("r.place")) & (F.col("r.most") >= near * F.col("l.least") - 1e-6)
    found = l.join(r.hint("shuffle_replicate_nl"), meets).mapInArrow(_block_pairs(near, every_blank), _FOUND)
    own = sets.filter("n = 0").select("bucket", "place", "record_id", "n", F.lit(0).cast("long").alias("h"))
    if not every_blank:
        hashes = packed.mapInArrow(_set_hashes, "bucket string, place int, record_id long, n int, h long")
        several = hashes.groupBy("bucket", "n", "h").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("bucket", "n", "h")
        own = own.unionByName(hashes.join(several, ["bucket", "n", "h"]))
    alike = _equal_pairs(own, every_blank, ["n", "h"])
    score = F.when(F.col("n") == 0, F.lit(both_empty)).otherwise(F.lit(float(sum(scores.LOOKUP))))
    for side in "lr":
        alike = alike.join(place.selectExpr("bucket", f"place as {side}p", f"province as {dict(l='left', r='right')[side]}_prov"), ["bucket", f"{side}p"])
    pair = F.format_string("%06d-%06d", "lp", "rp").alias("prov_pair")
    return found.union(alike.select("bucket", "left_id", "right_id", pair, score.alias("score"), "left_prov", "right_prov"))


PAIR_ORDER = ["score", "prov_pair", "left_id", "right_id"]
#: Up to so many pairs one task folds all, and of a component it folds so many at a time; beyond that the first band of pairs is this share.
LAST_PAIRS, FOLD_PAIRS, BANDS = 500_000, 500_000, 16
#: Small components are folded together, about so many pairs in a task.
LOT_PAIRS = 50_000
#: Up to so many records with a group go to the tasks that read pairs; bands are cut at the keys of about so many sampled pairs, and hold so many pairs at least.
MAP_MEMBERS, CUT_PAIRS, LEAST_BAND = 2_000_000, 20_000, 20_000
_MEMBERS = "bucket string, record_id long, province string, group long, score double, prov_pair string"


def _fold(pairs: pa.Table) -> pa.Table:
    """(bucket, record_id, province, group, score, prov_pair): what the pairs, taken in order, add to groups.

    A pair of two records without a group founds one, named by its left record; a record without a group joins the other's
    group if that has no code of its province. left_group, right_group: groups already known; left_taken, right_taken: their provinces, as JSON.
    score, prov_pair: those of the pair that founded the group, for both its records.
    """
    whole = {c: pairs[c].combine_chunks() for c in pairs.column_names}
    sides = ("left", "right")
    ids, score = [whole[f"{s}_id"].to_numpy() for s in sides], whole["score"].to_numpy()
    places = whole["prov_pair"].dictionary_encode()
    rank = np.argsort(np.argsort(np.array(places.dictionary.to_pylist(), dtype=object)))[places.indices.to_numpy()]
    order = np.lexsort((ids[1], ids[0], rank, -score))
    _, at = np.unique(np.concatenate(ids), return_inverse=True)
    at = [at[: len(score)], at[len(score) :]]
    records = [x.tolist() for x in at]
    # provinces are bits of a number
    bits: dict[str | None, int] = {}
    bit: list[list[int]] = []
    group, taken, names = [-1] * (max(map(max, records), default=-1) + 1 if len(score) else 0), [], []
    number: dict[int, int] = {}
    for side, own in enumerate(sides):
        provinces = whole[f"{own}_prov"].dictionary_encode(null_encoding="encode")
        own_bits = [bits.setdefault(p, 1 << len(bits)) for p in provinces.dictionary.to_pylist()]
        bit.append([own_bits[k] for k in provinces.indices.to_pylist()])
        named, listed = whole[f"{own}_group"], whole[f"{own}_taken"]
        known = np.flatnonzero(named.is_valid().to_numpy(zero_copy_only=False))
        for i in known[np.unique(at[side][known], return_index=True)[1]].tolist():
            if (name := named[i].as_py()) not in number:
                number[name] = len(names)
                names.append(name)
                taken.append(sum(bits.setdefault(p, 1 << len(bits)) for p in json.loads(listed[i].as_py())))
            group[records[side][i]] = number[name]
    added: list[tuple[int, int, int, bool]] = []
    for i in order.tolist():
        a, b = records[0][i], records[1][i]
        ga, gb = group[a], group[b]
        if ga < 0 and gb < 0:
            group[a] = group[b] = g = len(names)
            names.append(int(ids[0][i]))
            taken.append(bit[0][i] | bit[1][i])
            added += [(i, 0, g, True), (i, 1, g, True)]
        elif ga < 0 or gb < 0:
            side, g = (0, gb) if ga < 0 else (1, ga)
            if not taken[g] & bit[side][i]:
                group[records[side][i]] = g
                taken[g] |= bit[side][i]
                added.append((i, side, g, False))
    row, side, g, founds = (np.array(x) for x in zip(*added, strict=True)) if added else (np.zeros(0, np.int64),) * 4
    row, founds = pa.array(row.astype(np.int64)), pa.array(founds.astype(bool))
    left = pa.array(side == 0)
    of = lambda c: pc.if_else(left, whole[f"left_{c}"].take(row), whole[f"right_{c}"].take(row))
    founding = [pc.if_else(founds, whole[c].take(row), pa.scalar(None, whole[c].type)) for c in ("score", "prov_pair")]
    return pa.table([whole["bucket"].take(row), of("id"), of("prov"), pa.array(np.array(names, dtype=np.int64)[g.astype(np.int64)]), *founding], names=[c.split()[0] for c in _MEMBERS.split(", ")])


def _undecided(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs that may still do something, with the groups of their records and the provinces these have.

    Most pairs do nothing any more, so they are looked up where they are read, as long as members are counted to be few.
    """
    taken = members.groupBy("group").agg(F.collect_set("province").alias("taken"))  # a code of each province at most
    known = members.select("record_id", "group").join(taken, "group")
    few = members.count() <= MAP_MEMBERS
    for side in ("left", "right"):
        own = known.selectExpr(f"record_id as {side}_id", f"group as {side}_group", f"taken as {side}_taken")
        pairs = pairs.join(F.broadcast(own) if few else own, f"{side}_id", "left")
    both = F.col("left_group").isNotNull() & F.col("right_group").isNotNull()
    blocked = F.coalesce(F.array_contains("left_taken", F.col("right_prov")), F.lit(False)) | F.coalesce(F.array_contains("right_taken", F.col("left_prov")), F.lit(False))
    # lists are slow to pass to a task's Python
    return pairs.filter(~both & ~blocked).withColumns({f"{side}_taken": F.to_json(f"{side}_taken") for side in ("left", "right")})


def _fold_band(band: DataFrame, members: DataFrame, path: str | None, last_pairs: int, fold_pairs: int) -> tuple[DataFrame, str | None, int]:
    """members, stored, with what a band of consecutive pairs adds, and how many of its pairs were undecided.

    Only pairs of one component of records and groups depend on each other, so components are folded side by side. A component of more
    than fold_pairs pairs is folded from its beginning, so many at a time.
    """
    spark = band.sparkSession
    rest_path, undecided = None, None
    while True:
        left, left_path = stored(_undecided(band, members).withColumns({"a": F.coalesce("left_group", "left_id"), "b": F.coalesce("right_group", "right_id")}), "link-band")
        n = left.count()
        undecided = n if undecided is None else undecided
        rest = None
        if n <= last_pairs:
            now = left.withColumn("lot", F.lit(0).cast("long"))
        else:
            parts = connected_components(left.select(F.col("a").alias("u"), F.col("b").alias("v")), "link-components")
            now = left.join(parts.withColumnRenamed("node", "a"), "a")
            large = now.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > fold_pairs)
            if not large.isEmpty():
                now = now.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("score"), *PAIR_ORDER[1:])))
                now, rest = now.filter(F.col("place") <= fold_pairs), now.filter(F.col("place") > fold_pairs)
            # a call for each of many small components would take longer than their pairs
            now = now.withColumn("lot", F.pmod(F.xxhash64("component"), F.lit(n // LOT_PAIRS + 1)))
        if n:
            added = now.groupBy("lot").applyInArrow(_fold, _MEMBERS)
            last, (members, path) = path, stored(members.union(added), "link-members")
            if last:
                discard(spark, last)
        last = rest_path
        if rest is not None:
            band, rest_path = stored(rest.select(*band.columns), "link-rest")
        discard(spark, left_path)
        if last:
            discard(spark, last)
        if rest is None:
            return members, path, undecided


def _fold_bands(pairs: DataFrame, n: int, last_pairs: int, bands: int, fold_pairs: int) -> DataFrame:
    """The members after n stored pairs, taken band by band in their order.

    Bands are cut at the keys of sampled pairs; where the cuts are changes no result. The first holds the bands-th part of the pairs or
    last_pairs, a later one twice as many as the last at most, and so many that about last_pairs would be undecided at the last one's
    share. Pairs aren't sorted or shuffled for this: a band is a filter on the stored table, whose pages are skipped by score.
    """
    spark = pairs.sparkSession
    key = [(-F.col("score")).alias("s"), *map(F.col, PAIR_ORDER[1:])]
    kinds = dict(s="double", prov_pair="string", left_id="long", right_id="long")
    sampled = sorted(map(tuple, pairs.select(*key).sample(min(1.0, CUT_PAIRS / n), seed=1).collect()))
    each = n / (len(sampled) + 1)  # pairs between two cuts
    members, path = spark.createDataFrame([], _MEMBERS), None
    step = min(n / bands, max(last_pairs, LEAST_BAND))
    at, before = 0, None
    while at is not None:
        at += max(1, round(step / each))
        cut = sampled[at - 1] if at <= len(sampled) else None
        band = pairs
        for bound, first in ((before, True), (cut, False)):
            if bound is not None:
                place = F.struct(*(F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(bound, kinds.items(), strict=True)))
                # the score by itself, so that reading stops at it
                band = band.filter((F.col("score") <= -bound[0]) & (F.struct(*key) > place) if first else (F.col("score") >= -bound[0]) & (F.struct(*key) <= place))
        members, path, undecided = _fold_band(band, members, path, last_pairs, fold_pairs)
        before, at = cut, at if cut is not None else None
        step = min(2 * step, max(LEAST_BAND, last_pairs * step / max(undecided, 1)))
    return members


def greedy_groups(pairs: DataFrame, records: DataFrame, last_pairs: int = LAST_PAIRS, bands: int = BANDS, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """(bucket, record_id, group_no): the order-dependent fold over accepted pairs.

    Pairs are taken in order (see PAIR_ORDER). last_pairs or fewer are one task's. More are stored once and read band by band of consecutive
    pairs, one round each: pairs whose records both have a group, or whose joiner's province is taken, have no effect any more
    and go, and the components of the others are folded side by side. Groups are numbered within their bucket in the
    order of the pairs that founded them.
    """
    spark = pairs.sparkSession
    who = records.select("record_id", "province")
    for side in ("left", "right"):
        if f"{side}_prov" not in pairs.columns:
            pairs = pairs.join(who.selectExpr(f"record_id as {side}_id", f"province as {side}_prov"), f"{side}_id")
    pairs, path = stored(pairs.select("bucket", *PAIR_ORDER, "left_prov", "right_prov").sortWithinPartitions(F.desc("score")), "link-pairs")
    n = pairs.count()
    if n <= last_pairs:
        none = {"left_group": F.lit(None).cast("long"), "right_group": F.lit(None).cast("long"), "left_taken": F.lit(None).cast("string"), "right_taken": F.lit(None).cast("string")}
        members = materialise(pairs.withColumns({"all": F.lit(0), **none}).groupBy("all").applyInArrow(_fold, _MEMBERS), "link-members")
    else:
        members = _fold_bands(pairs, n, last_pairs, bands, fold_pairs)
    discard(spark, path)
    # a group's left founder names it, so that order is the founding pairs'
    founders = members.filter("record_id = group").selectExpr("bucket", "group", "-score as s", "prov_pair")
    no = numbered(founders, ["bucket"], ["s", "prov_pair", "group"], "group_no").select("group", (F.col("group_no") + 1).alias("group_no"))
    return members.join(no, "group").select("bucket", "record_id", "group_no")


def top_keys(records: DataFrame, groups: DataFrame) -> DataFrame:
    """records (record_id, province, fsc_code, bucket) with top_key: group numbers in order of creation, then single records in order.

    Records without a category have a key of their own and are not numbered.
    """
    keep = records.columns
    r = records.join(groups.select("record_id", "group_no"), "record_id", "left")
    named = F.concat(F.col("bucket"), F.lit("_"), F.format_string("%04d", F.col("group_no")))
    none = F.col("bucket") == NO_CATEGORY
    grouped = r.filter(none | F.col("group_no").isNotNull()).withColumn("top_key", F.when(none, F.concat_ws("_", F.lit(NO_CATEGORY), "province", "fsc_code")).otherwise(named))
    base = groups.groupBy("bucket").agg(F.max("group_no").alias("base"))
    single = numbered(r.filter(~none & F.col("group_no").isNull()).drop("group_no"), ["bucket"], ["record_id"], "no").join(base, "bucket", "left")
    single = single.withColumn("group_no", F.coalesce("base", F.lit(0)) + F.col("no") + 1).withColumn("top_key", named)
    return grouped.select(*keep, "top_key").unionByName(single.select(*keep, "top_key"))


def link(records: DataFrame, dense: bool = False) -> DataFrame:
    """records (record_id, province, fsc_code, NGS_code, fsc_fn, fsc_description) with top_key."""
    tokens = text.tokens(F.concat_ws(" ", text.text_or_blank("fsc_fn"), text.text_or_blank("fsc_description")))
    r = records.withColumn("bucket", bucket_of(F.col("NGS_code")))
    narrow = r.select("record_id", "province", "bucket", tokens.alias("tokens"))
    pairs = (bucket_pairs_dense if dense else bucket_pairs)(narrow, every_blank=False)
    return top_keys(r, greedy_groups(pairs, r)).drop("bucket")


def group_sizes(keyed: DataFrame, key: str = "top_key") -> DataFrame:
    """One row: groups, groups of several, single records, and the largest group."""
    n = keyed.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("cross_groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


def sample_groups(keyed: DataFrame, key: str = "top_key", members: Sequence[str] = ("province", "fsc_code"), limit: int = 8) -> DataFrame:
    """The first `limit` groups, by key, of two to four records of several provinces."""
    rows = F.array_sort(F.collect_list(F.struct(*members)))
    # a set's size, since a distinct count would have the records shuffled twice
    g = keyed.groupBy(key).agg(F.count("*").alias("n"), F.size(F.collect_set("province")).cast("long").alias("provinces"), rows.alias("members"))
    return g.filter("n between 2 and 4 and provinces >= 2").orderBy(key).limit(limit)
