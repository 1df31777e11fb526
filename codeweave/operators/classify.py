"""The cascade from code to category: role table, keyword rules, token similarity, section fallback; the first hit holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from .topk import top_by_token_sets

ACCEPT = 0.10
#: Scores of the steps that don't compute one.
ROLE_SCORE, KEYWORD_SCORE, SECTION_SCORE = 1.0, 0.9, 0.2


def role_index(roles: DataFrame, order: str = "ord") -> DataFrame:
    """(province, role_code, ngs_code): first category of each row that has one; the last row of a key wins, and of each role under ALL."""
    first = roles.filter("size(ngs_codes) > 0").select("province", F.btrim("role_code").alias("role_code"), F.col("ngs_codes")[0].alias("ngs_code"), order)
    both = first.unionByName(first.withColumn("province", F.lit("ALL")))
    return both.groupBy("province", "role_code").agg(F.max_by("ngs_code", order).alias("ngs_code"))


def role_lookup(codes: DataFrame, roles: DataFrame, order: str = "ord") -> DataFrame:
    """codes (province, role) with role_ngs: the province's own entry, else ALL's."""
    index = role_index(roles, order).filter("role_code <> ''")
    own = index.filter("province <> 'ALL'").select("province", F.col("role_code").alias("role"), F.col("ngs_code").alias("_own"))
    shared = index.filter("province = 'ALL'").select(F.col("role_code").alias("role"), F.col("ngs_code").alias("_all"))
    return codes.join(own, ["province", "role"], "left").join(shared, "role", "left").withColumn("role_ngs", F.coalesce("_own", "_all")).drop("_own", "_all")


def first_category(categories: DataFrame, order: str = "ord") -> DataFrame:
    """The category dimension with one row a code, the first."""
    return categories.groupBy("ngs_code").agg(F.min_by("ngs_label", order).alias("ngs_label"))


def with_label(df: DataFrame, categories: DataFrame, code: str, out: str, order: str = "ord") -> DataFrame:
    dim = first_category(categories, order).select(F.col("ngs_code").alias(code), F.col("ngs_label").alias(out))
    return df.join(dim, code, "left")


def _score_blocks(cells: np.ndarray, starts: np.ndarray, vocabulary: pa.Array, weights: tuple[float, float], least: float, block: int):
    """(id, place, score, shared) of the best right row of each left row: 0/1 blocks of left rows against the right rows' 0/1 matrix.

    vocabulary: the right rows' tokens in order; cells[starts[i]:starts[i + 1]] are those of row i.
    """
    j, o = weights
    sizes = np.diff(starts).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros((len(sizes), len(vocabulary)), dtype=np.float32)
        right[np.repeat(np.arange(len(sizes)), np.diff(starts)), cells] = 1
        for batch in batches:
            tokens = batch.column("tokens")
            ends = np.append(0, np.cumsum(np.array(pc.list_value_length(tokens).to_pylist(), dtype=np.int64)))
            column = pc.index_in(tokens.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
            for at in range(0, len(batch), block):
                own = ends[at : at + block + 1]
                row, cell = np.repeat(np.arange(len(own) - 1), np.diff(own)), column[own[0] : own[-1]]
                row, cell = row[cell >= 0], cell[cell >= 0]
                left = np.zeros((len(own) - 1, len(vocabulary)), dtype=np.float32)
                left[row, cell] = 1
                n, na = (left @ right.T).astype(np.float64), np.diff(own)[:, None].astype(np.float64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(n > 0, j * (n / (na + sizes - n)) + o * (n / na), 0.0)
                place = score.argmax(axis=1)  # the first of equal ones
                score = score[np.arange(len(place)), place]
                good = np.flatnonzero(score >= least)
                row, cell = np.nonzero(left[good] * right[place[good]])
                shared = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(good) + 1)).astype(np.int32)), vocabulary.take(pa.array(cell)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, block).take(pa.array(good)), pa.array(place[good]), pa.array(score[good]), shared], names=["id", "place", "score", "shared"])

    return run


#: Up to so many cells a right side is one matrix, which every task gets whole; beyond it both sides are shuffled by token.
MAX_CELLS, BLOCK = 20_000_000, 256


def best_by_tokens(left: DataFrame, right: DataFrame, weights: tuple[float, float] = scores.CLASSIFY, least: float = ACCEPT, max_cells: int = MAX_CELLS) -> DataFrame:
    """(id, other, score, shared): for each left row the right row of highest score, the least `ord` of equal ones, if it reaches `least`.

    left: id, tokens; right: other, ord, tokens. The right side is a dimension: if it is counted to be small, it goes to every task as
    a 0/1 matrix, and left rows are scored where they lie. Otherwise left rows meet right ones by their rarest tokens until nothing
    better can come (see topk). Common tokens are looked up for the winners only.
    """
    size = right.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    if 0 < size["rows"] * size["tokens"] <= max_cells:
        known = right.orderBy("ord").select("other", "tokens").toArrow()
        tokens = known.column("tokens").combine_chunks()
        vocabulary = pc.unique(tokens.flatten())
        vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
        starts = np.append(0, np.cumsum(pc.list_value_length(tokens).to_pylist())).astype(np.int64)
        run = _score_blocks(pc.index_in(tokens.flatten(), value_set=vocabulary).to_numpy(), starts, vocabulary, weights, least, BLOCK)
        scored = left.select("id", "tokens").mapInArrow(run, f"id {left.schema['id'].dataType.simpleString()}, place long, score double, shared array<string>")
        others = left.sparkSession.createDataFrame(list(enumerate(known.column("other").to_pylist())), f"place long, other {right.schema['other'].dataType.simpleString()}")
        return scored.join(F.broadcast(others), "place").select("id", "other", "score", "shared")
    # beyond it the sets meet by rarest tokens until no better one can come
    found = top_by_token_sets(left.select(F.col("id").alias("anchor_id"), "tokens"), right.select(F.struct("ord", "other").alias("record_id"), "tokens"), 1, weights, None, least, fill=False)
    best = found.select(F.col("anchor_id").alias("id"), "record_id.*", F.col("sim_score").alias("score"))
    both = best.join(left.select("id", "tokens"), "id").join(right.select("other", "ord", F.col("tokens").alias("_t")), ["other", "ord"])
    return both.select("id", "other", "score", F.array_sort(F.array_intersect("tokens", "_t")).alias("shared"))


def _hit(code: Column, label: Column, rationale: Column, confidence: Column, method: str, score: Column, observed: Column | None = None) -> Column:
    return F.struct(code.alias("NGS_code"), F.coalesce(label, F.lit("")).alias("NGS_label"), rationale.alias("NGS_rationale"), confidence.alias("NGS_confidence"), F.lit(method).alias("match_method"), score.cast("double").alias("match_score"), (F.lit("") if observed is None else observed).alias("NGS_key_observations"))


def cascade(fees: DataFrame, categories: DataFrame, roles: DataFrame, keyword_rules=rules.KEYWORD_RULES, section_rules=rules.SECTION_RULES, id_col: str = "record_id") -> DataFrame:
    """fees with NGS_code, NGS_label, NGS_rationale, NGS_confidence, match_method, match_score NGS_key_observations and the empty NGS notes.

    fees: id_col, province, fsc_code, fsc_fn, fsc_description, fsc_section, fsc_chapter. categories: ngs_code, ngs_label,
    ngs_description, ord. Only rows that neither role table nor keywords decide go to the similarity join.
    """
    blank = lambda c: text.text_or_blank(c)
    whole = F.concat(blank("fsc_fn"), F.lit(" "), blank("fsc_description"), F.lit(" "), blank("fsc_section"), F.lit(" "), blank("fsc_chapter"))
    work = fees.withColumn("_text", whole).withColumn("_dec", text.decoded_code(blank("fsc_code"), F.col("province"))).withColumn("role", F.col("_dec.role"))
    work = role_lookup(work, roles)
    work = work.withColumn("_kw", rules.first_rule(F.col("_text"), keyword_rules))
    work = work.withColumn("kw_ngs", rules.rule_field(F.col("_kw"), keyword_rules, 1)).withColumn("_section", rules.section_category(F.col("fsc_section"), F.col("fsc_chapter"), section_rules))
    open_rows = work.filter("role_ngs is null and _kw is null").select(F.col(id_col).alias("id"), text.tokens(F.col("_text"), text.STOP_CLASSIFY).alias("tokens"))
    known = categories.select(F.col("ngs_code").alias("other"), "ord", text.tokens(F.concat(blank("ngs_label"), F.lit(" "), blank("ngs_description")), text.STOP_CLASSIFY).alias("tokens"))
    similar = best_by_tokens(open_rows, known).select(F.col("id").alias(id_col), F.col("other").alias("_sim"), F.col("score").alias("_score"), F.slice("shared", 1, 8).alias("_shared"))
    work = work.join(similar, id_col, "left")
    for code, label in (("role_ngs", "_l1"), ("kw_ngs", "_l2"), ("_sim", "_l3"), ("_section", "_l4")):
        work = with_label(work, categories, code, label)
    hit = (
        F.when(F.col("role_ngs").isNotNull(), _hit(F.col("role_ngs"), F.col("_l1"), F.concat(F.lit("Role code '"), F.col("role"), F.lit("' maps to NGS "), F.col("role_ngs")), F.lit("high"), "role_code_table", F.lit(ROLE_SCORE)))
        .when(F.col("_kw").isNotNull(), _hit(F.col("kw_ngs"), F.col("_l2"), rules.rule_field(F.col("_kw"), keyword_rules, 2), F.lit("high"), "keyword_rule", F.lit(KEYWORD_SCORE)))
        .when(F.col("_sim").isNotNull(), _hit(F.col("_sim"), F.col("_l3"), F.concat(F.lit("Shared terms: "), F.array_join("_shared", ", ")), scores.confidence(F.col("_score")), "text_similarity", F.round("_score", 4), F.format_string("Score=%.3f", "_score")))
        .when(F.col("_section").isNotNull(), _hit(F.col("_section"), F.col("_l4"), F.lit("Section/chapter keyword fallback"), F.lit("low"), "section_fallback", F.lit(SECTION_SCORE)))
        .otherwise(_hit(F.lit(""), F.lit(""), F.lit(""), F.lit("very_low"), "", F.lit(0.0)))
    )
    out = work.withColumn("_hit", hit).select(*[F.col(c) for c in fees.columns], "_hit.*")
    return out.withColumns({c: F.lit("") for c in ("NGS_notes", "NGS_other")})
