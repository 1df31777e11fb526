"""The lookup API: codes of a province, substring search, the closest codes of another province by tokens or vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .cells import VectorCells
from .graph import materialise
from .records import last_wins
from .substrings import SubstringIndex, contains_query
from .topk import top_by_token_sets

#: Provinces in their order.
PROVINCES = ("ON", "BC", "YT")


def record_tokens() -> Column:
    c = text.record_text(*[F.col(x) for x in ("fsc_fn", "fsc_description", "fsc_section", "fsc_subsection", "fsc_chapter", "NGS_label")])
    return text.tokens(c)


def same_category(anchor: Column, other: Column) -> Column:
    return F.coalesce((F.coalesce(anchor, F.lit("")) != "") & (anchor != "NOMAP") & (anchor == other), F.lit(False))


def category_flag(anchor: Column, other: Column) -> Column:
    """What a reader sees beside a match: same, different, or nothing where either has no category."""
    known = lambda c: F.coalesce(c, F.lit("")).isin("", "NOMAP")
    return F.when(known(anchor) | known(other), "").when(anchor == other, "same NGS").otherwise("diff NGS")


def find_anchor(records: DataFrame, code: str, province: str) -> DataFrame:
    """The record of least record_id with the code, in any case, in the province; no row if there is none."""
    hit = (F.col("province") == province) & (text.canonical_code(F.col("fsc_code")) == code.strip().upper())
    return records.filter(hit).orderBy("record_id").limit(1)


def search_text(records: DataFrame, query: str, province: str | None = None, limit: int = 20) -> DataFrame:
    """Records (of the province, or of all) whose code or name contains the query, ignoring case, by record_id; none for a blank query.

    One scan; SubstringIndex answers the same from stored grams.
    """
    q = query.strip()
    if not q:
        return records.limit(0)
    here = records if province is None else records.filter(F.col("province") == province)
    return here.filter(contains_query("fsc_code", "fsc_fn", q)).orderBy("record_id").limit(limit)


def top_by_tokens(anchor: DataFrame, candidates: DataFrame, n: int = 5) -> DataFrame:
    """candidates with sim_score (rounded to 4) and rank against one anchor; candidates without common tokens count 0 and may fill up.

    Both have record_id and tokens. The anchor is one row, so it is broadcast and each candidate scored in place.
    """
    one = anchor.select(F.col("tokens").alias("_a")).limit(1)
    scored = candidates.join(F.broadcast(one), how="cross").withColumn("sim_score", F.round(scores.token_score(F.col("_a"), F.col("tokens")), 4)).drop("_a")
    return _ranked(scored.orderBy(F.desc("sim_score"), "record_id").limit(n))


def top_by_vectors(anchor: DataFrame, candidates: DataFrame, n: int = 5) -> DataFrame:
    """candidates with sim_score, the inner product of embeddings, and rank against one anchor; rows without a vector drop out, and one without gives no rows."""
    one = anchor.filter("embedding is not null").select(F.col("embedding").alias("_a")).limit(1)
    scored = candidates.filter("embedding is not null").join(F.broadcast(one), how="cross").withColumn("sim_score", scores.dot(F.col("_a"), F.col("embedding"))).drop("_a")
    return _ranked(scored.orderBy(F.desc("sim_score"), "record_id").limit(n))


def _ranked(top: DataFrame) -> DataFrame:
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim_score"), "record_id")))  # n rows


def batch_by_tokens(anchors: DataFrame, candidates: DataFrame, n: int = 5) -> DataFrame:
    """(anchor_id, record_id, sim_score, rank) for many anchors (anchor_id, tokens) over candidates (record_id, tokens).

    Ranked by score rounded to 4, then record_id; candidates without a common token count 0 and may fill up. Anchors meet candidates by
    their rarest tokens until nothing better can come (see topk).
    """
    return top_by_token_sets(anchors, candidates, n, scores.LOOKUP)


def batch_by_vectors(anchors: DataFrame, candidates: DataFrame, n: int = 5) -> DataFrame:
    """The same by inner product of (anchor_id, embedding) and (record_id, embedding); rows without a vector drop out.

    Candidates are put in cells, of which an anchor visits those that may hold one of its best (see cells).
    """
    return VectorCells.build(candidates).search(anchors.filter("embedding is not null"), n)[0]


class Lookup:
    """Searches over a table of records (see FIXTURES: linked), with vectors (record_id, embedding) or without.

    categories (ngs_code, ngs_label, ngs_description, ord), if given, say what an anchor's category is called; of several rows of a code the last counts.
    """

    def __init__(self, records: DataFrame, embeddings: DataFrame | None = None, categories: DataFrame | None = None):
        self.records = records.withColumn("tokens", record_tokens())
        self.embeddings = embeddings
        self.categories = None if categories is None else last_wins(categories.select("ngs_code", F.struct("ngs_label", "ngs_description").alias("named"), "ord"), ["ngs_code"], "named", "ord")
        self._substrings: SubstringIndex | None = None

    @property
    def embedding_available(self) -> bool:
        return self.embeddings is not None

    @property
    def score_method(self) -> str:
        return "semantic" if self.embedding_available else "jaccard"

    def provinces(self) -> DataFrame:
        return province_list(self.records)

    def all_codes_for_province(self, province: str) -> DataFrame:
        """The province's distinct codes, in order."""
        return distinct_codes(self.records.filter(F.col("province") == province)).orderBy("fsc_code")

    def fuzzy_search(self, query: str, province: str | None = None, limit: int = 20) -> DataFrame:
        """The first records, by record_id, whose code or name contains the query; from an index that the first search builds."""
        if self._substrings is None:
            self._substrings = SubstringIndex.build(self.records.drop("tokens"))
        return self._substrings.search(query, province, limit)

    def with_category(self, anchors: DataFrame) -> DataFrame:
        """anchors (NGS_code, NGS_label) with anchor_label and anchor_description of their category; without a row of it the record's own label, and no description."""
        label = F.coalesce(F.col("NGS_label") if "NGS_label" in anchors.columns else F.lit(None), F.lit(""))
        if self.categories is None:
            return anchors.withColumns({"anchor_label": label, "anchor_description": F.lit("")})
        named = anchors.join(self.categories.withColumnRenamed("ngs_code", "_code"), F.col("NGS_code") == F.col("_code"), "left")
        return named.withColumns({"anchor_label": F.coalesce("named.ngs_label", label), "anchor_description": F.coalesce("named.ngs_description", F.lit(""))}).drop("_code", "named")

    def search(self, code: str, in_province: str, out_province: str, top_n: int = 5) -> DataFrame:
        """One row a match: anchor_code, anchor_label, anchor_description, rank, the record's columns, sim_score, ngs_match, score_method.

        No rows without the anchor. An anchor that has no vector where there are vectors is an error; candidates without one drop out.
        """
        anchor, candidates = find_anchor(self.records, code, in_province), self.records.filter(F.col("province") == out_province)
        if self.embedding_available:
            anchor = anchor.join(self.embeddings.select("record_id", "embedding"), "record_id", "left")
            if not anchor.filter("embedding is null").isEmpty():
                raise LookupError(f"{in_province} {code.strip().upper()} has no vector")
            candidates = candidates.join(self.embeddings.select("record_id", "embedding"), "record_id")
        found = (top_by_vectors if self.embedding_available else top_by_tokens)(anchor, candidates, top_n)
        one = self.with_category(anchor).select(F.col("fsc_code").alias("anchor_code"), F.col("NGS_code").alias("_ngs"), "anchor_label", "anchor_description")
        found = found.join(F.broadcast(one), how="cross")
        return found.withColumn("ngs_match", same_category(F.col("_ngs"), F.col("NGS_code"))).withColumn("score_method", F.lit(self.score_method)).drop("_ngs", "tokens", "embedding")

    def _anchors(self, anchors: DataFrame) -> DataFrame:
        """(anchor_id, tokens): the first record of each (province, fsc_code)."""
        wanted = anchors.select("province", text.canonical_code(F.col("fsc_code")).alias("_code")).distinct()
        keyed = self.records.withColumn("_code", text.canonical_code(F.col("fsc_code"))).join(wanted, ["province", "_code"])
        first = keyed.groupBy("province", "_code").agg(F.min_by(F.struct("record_id", "tokens"), "record_id").alias("r"))
        return first.select(F.col("r.record_id").alias("anchor_id"), F.col("r.tokens").alias("tokens"))

    def search_batch(self, anchors: DataFrame, out_province: str, top_n: int = 5) -> DataFrame:
        """search for many anchors (province, fsc_code) at once, by vectors where there are any, else by tokens: anchor_id, record_id, sim_score, rank."""
        chosen = self._anchors(anchors)
        candidates = self.records.filter(F.col("province") == out_province)
        if not self.embedding_available:
            return batch_by_tokens(chosen, candidates.select("record_id", "tokens"), top_n)
        vectors = self.embeddings.select("record_id", "embedding")
        chosen = chosen.select("anchor_id").join(vectors.withColumnRenamed("record_id", "anchor_id"), "anchor_id", "left")
        without = chosen.filter("embedding is null").limit(1).collect()
        if without:
            raise LookupError(f"record {without[0]['anchor_id']} has no vector")
        return batch_by_vectors(chosen, candidates.select("record_id").join(vectors, "record_id"), top_n)

    def export(self, anchors: DataFrame, out_province: str, top_n: int = 5) -> DataFrame:
        """What an export shows of many searches: for each anchor (province, fsc_code) an ANCHOR row, then its MATCH rows.

        anchor_id, rank (0 for the anchor, so that both give the order), anchor_code, row_type, sim_score, score_method, ngs_match and the records' columns.
        """
        records = self.records.drop("tokens")
        found = materialise(self.search_batch(anchors, out_province, top_n), "lookup-found")
        own = self._anchors(anchors).select("anchor_id").join(records.withColumn("anchor_id", F.col("record_id")), "anchor_id")
        head = own.select("anchor_id", F.col("fsc_code").alias("anchor_code"), F.col("NGS_code").alias("_ngs"))
        first = own.withColumns({"rank": F.lit(0), "anchor_code": F.col("fsc_code"), "row_type": F.lit("ANCHOR"), "sim_score": F.lit(None).cast("double"), "ngs_match": F.lit(False)})
        rest = found.join(records, "record_id").join(head, "anchor_id").withColumns({"row_type": F.lit("MATCH"), "ngs_match": same_category(F.col("_ngs"), F.col("NGS_code"))}).drop("_ngs")
        return first.unionByName(rest).withColumn("score_method", F.lit(self.score_method))


def province_list(records: DataFrame, provinces=PROVINCES) -> DataFrame:
    """The known provinces that occur, in their fixed order."""
    place = F.array_position(F.array(*map(F.lit, provinces)), F.col("province")).cast("int")
    return records.filter(F.col("province").isin(*provinces)).groupBy("province").agg(F.max(place).alias("place")).orderBy("place")


def distinct_codes(records: DataFrame) -> DataFrame:
    return records.filter(text.nonblank("fsc_code").isNotNull()).select("province", "fsc_code").distinct()


def sample_codes(records: DataFrame, size: int = 15) -> DataFrame:
    """(province, codes): the first codes of each province; partial results hold `size` codes at most once ranked."""
    w = Window.partitionBy("province").orderBy("fsc_code")
    first = distinct_codes(records).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= size)
    return first.groupBy("province").agg(F.sort_array(F.collect_list("fsc_code")).alias("codes"))
