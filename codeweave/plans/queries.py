"""The queries of the resolution engine over the driver's tables, each with its DuckDB SQL where SQL can express it.

Stand-ins: documents are records (doc_id the record id, the number in `source` modulo 3 the province, `lang` the category, lines the
pages' lines), benchmark items are categories, conversations are documents of pages, other tables give codes, prices and dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from ..operators import classify, ingest, layout, link, lookup, metrics, pages, records, reference_docs, substrings
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PROV_SQL = "case cast(substr(source, 4) as int) % 3 when 0 then 'ON' when 1 then 'BC' else 'YT' end"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{text.SPACE}+|{text.SPACE}+$', '', 'g')"


def squeezed_sql(old: str, new: str) -> str:
    """The text with characters replaced and white space squeezed."""
    return strip_sql(f"regexp_replace(translate(text, {old}, {new}), '{text.SPACE}+', ' ', 'g')")


CLEAN_SQL = squeezed_sql("'–—’‘' || chr(160) || '®' || chr(65533) || '•'", "'--'''' '")
NORM_SQL = squeezed_sql("'–—’é' || chr(160) || chr(65533)", "'--''e '")



def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tokens_sql(x: str, stop: list[str] = text.STOP_LOOKUP) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in ({_in(stop)})))"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def province(source: Column) -> Column:
    return F.element_at(F.array(F.lit("ON"), F.lit("BC"), F.lit("YT")), (F.substring(source, 4, 10).cast("int") % 3) + 1)


def doc_records(t) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return t("documents").select(
        F.col("doc_id").alias("record_id"), province(F.col("source")).alias("province"), F.col("lang").alias("bucket"), F.get(lines, F.lit(0)).alias("fsc_fn"), text.text_or_blank(F.get(lines, F.lit(1))).alias("fsc_description"), "source", "lang", "text",
    )


def doc_lines(t) -> DataFrame:
    return tables.split_lines(t("documents"), "text", "doc_id")


LINES_SQL = "(select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)"


# --- text and scalars


@query("clean_text", f"select doc_id, {CLEAN_SQL} as cleaned from documents")
def _(t):
    return t("documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("norm_text", f"select doc_id, {NORM_SQL} as normed from documents")
def _(t):
    return t("documents").select("doc_id", text.norm(F.col("text")).alias("normed"))


@query("strip_leaders", r"select p_partkey, trim(regexp_replace('- ' || p_name || '.....' || p_type || ' .', '\.{3,}', ' ', 'g'), ' .-') as name from part")
def _(t):
    return t("part").select("p_partkey", text.strip_leaders(F.concat(F.lit("- "), "p_name", F.lit("....."), "p_type", F.lit(" ."))).alias("name"))


@query("split_price", """select o_orderkey, 'Order ' || o_orderkey as name, case when o_orderkey % 2 = 1 then cast(cast(o_totalprice as decimal(12, 2)) as varchar) end as price from orders""")
def _(t):
    line = F.concat(F.lit("Order "), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit(" ....... $"), F.col("o_totalprice").cast("decimal(12,2)"), F.lit(" "))).otherwise(F.lit(" ....")))
    return t("orders").select("o_orderkey", text.without_price(line).alias("name"), text.price_at_end(line).alias("price"))


@query("tokenize", f"select doc_id, array_to_string(list_sort({tokens_sql('text')}), ' ') as lookup_tokens, array_to_string(list_sort({tokens_sql('text', text.STOP_CLASSIFY)}), ' ') as classify_tokens from documents")
def _(t):
    join = lambda stop: F.array_join(F.array_sort(text.tokens(F.col("text"), stop)), " ")
    return t("documents").select("doc_id", join(text.STOP_LOOKUP).alias("lookup_tokens"), join(text.STOP_CLASSIFY).alias("classify_tokens"))


_PAIRS_SQL = f"with d as (select doc_id, {tokens_sql('text')} as t from documents), p as (select a.doc_id, b.doc_id as next_id, a.t as a, b.t as b, len(list_intersect(a.t, b.t)) as n from d a join d b on b.doc_id = a.doc_id + 1)"


def _next_docs(t) -> DataFrame:
    d = t("documents").select("doc_id", text.tokens(F.col("text")).alias("a"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next_id"), F.col("a").alias("b")), "doc_id")


@query("token_set_ops", _PAIRS_SQL + " select doc_id, next_id, n as n_both, len(a) + len(b) - n as n_either, len(a) - n as n_left_only from p")
def _(t):
    return _next_docs(t).select("doc_id", "next_id", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_either"), F.size(F.array_except("a", "b")).cast("long").alias("n_left_only"))


@query("jaccard_pairs", _PAIRS_SQL + """ select doc_id, next_id, round(case when len(a) = 0 or len(b) = 0 then 0.0 else 0.4 * (cast(n as double) / (len(a) + len(b) - n)) + 0.6 * (cast(n as double) / len(a)) end, 6) as lookup_score,
    round(case when len(a) = 0 or len(b) = 0 then 0.0 else 0.35 * (cast(n as double) / (len(a) + len(b) - n)) + 0.65 * (cast(n as double) / len(a)) end, 6) as classify_score from p""")
def _(t):
    s = lambda w: F.round(scores.token_score(F.col("a"), F.col("b"), w), 6)
    return _next_docs(t).select("doc_id", "next_id", s(scores.LOOKUP).alias("lookup_score"), s(scores.CLASSIFY).alias("classify_score"))


@query("upper_ratio", r"select doc_id, round(cast(len(regexp_extract_all(text, '\p{Lu}')) as double) / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 6) as ratio from documents")
def _(t):
    return t("documents").select("doc_id", F.round(text.upper_ratio(F.col("text")), 6).alias("ratio"))


@query("regex_extract_all", r"""with p as (select p_partkey, 'NGS ' || lpad(cast(p_size as varchar), 3, '0') || '.' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') || ' or 001.002' as x from part)
    select p_partkey, array_to_string(regexp_extract_all(x, '\d{3}\.\d{3}'), ',') as codes, array_to_string(regexp_extract_all(x, '(?i)NGS\s+(\d{3}\.\d{3})', 1), ',') as named from p""")
def _(t):
    x = F.concat(F.lit("NGS "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(" or 001.002"))
    return t("part").select("p_partkey", F.array_join(text.category_codes(x), ",").alias("codes"), F.array_join(text.named_category_codes(x), ",").alias("named"))


@query("confidence_label", """select o_orderkey, case when s >= 0.55 then 'high' when s >= 0.3 then 'medium' when s >= 0.15 then 'low' else 'very_low' end as label from (select o_orderkey, (o_orderkey % 100) / 100.0 as s from orders)""")
def _(t):
    return t("orders").select("o_orderkey", scores.confidence((F.col("o_orderkey") % 100) / 100.0).alias("label"))


@query("decode_code", """with c as (select c_custkey, case c_custkey % 3 when 0 then 'ON' when 1 then 'BC' else 'YT' end as p,
      case c_custkey % 3 when 0 then 'A' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || case when c_custkey % 2 = 0 then substr('BC9', 1 + cast(c_custkey % 3 as int), 1) || 'X' else '' end
        else lpad(cast(c_custkey % 1000 as varchar), 5, '0') end as code from customer)
    select c_custkey, code, case when p = 'ON' and length(code) >= 5 then substr(code, 1, 4) when p = 'BC' then coalesce(nullif(regexp_replace(code, '^0{1,2}', ''), ''), code) else code end as fee,
      case when p = 'ON' then case when length(code) >= 5 then substr(code, 5, 1) else 'A' end else '' end as role from c""")
def _(t):
    k = F.col("c_custkey")
    on = F.concat(F.lit("A"), F.lpad((k % 1000).cast("string"), 3, "0"), F.when(k % 2 == 0, F.concat(F.substring(F.lit("BC9"), 1 + (k % 3).cast("int"), F.lit(1)), F.lit("X"))).otherwise(""))
    c = t("customer").select("c_custkey", F.element_at(F.array(F.lit("ON"), F.lit("BC"), F.lit("YT")), (k % 3).cast("int") + 1).alias("p"), F.when(k % 3 == 0, on).otherwise(F.lpad((k % 1000).cast("string"), 5, "0")).alias("code"))
    return c.select("c_custkey", "code", text.decoded_code(F.col("code"), F.col("p")).alias("d")).select("c_custkey", "code", "d.fee", "d.role")


_HEADINGS = [f"The {key.lower()} of" for key, _label in rules.ON_CHAPTERS] + ["Other things"]


@query("chapter_map", "with s as (select s_suppkey, list_extract([" + _in(_HEADINGS) + f"], cast(s_suppkey % {len(_HEADINGS)} as int) + 1) as h from supplier), b as (select *, upper(replace(h, ' ', '')) as x from s) select s_suppkey, h as heading, case " + " ".join(f"when contains(x, '{k}') then '{v}'" for k, v in rules.ON_CHAPTERS) + " else x end as chapter from b")
def _(t):
    h = F.element_at(F.array(*map(F.lit, _HEADINGS)), (F.col("s_suppkey") % len(_HEADINGS)).cast("int") + 1)
    return t("supplier").select("s_suppkey", h.alias("heading"), rules.on_chapter(h).alias("chapter"))


@query("record_text", f"with r as (select doc_id, {strip_sql('string_split(text, chr(10))[1]')} as fn, {strip_sql('string_split(text, chr(10))[2]')} as d, source, lang from documents) select doc_id, concat_ws(' | ', nullif(fn, ''), nullif(d, ''), nullif(source, ''), nullif(lang, '')) as record_text from r")
def _(t):
    return doc_records(t).select(F.col("record_id").alias("doc_id"), text.record_text(F.col("fsc_fn"), F.col("fsc_description"), F.col("source"), F.lit(" "), F.col("lang"), F.lit(None).cast("string")).alias("record_text"))


@query("normalize_codes", """select case o_orderkey % 3 when 0 then 'ON' when 1 then 'BC' else 'YT' end as province, upper('k' || (o_orderkey % 500)) as fsc_code, lower(o_orderpriority) as fsc_fn, '' as fsc_chapter, cast(o_custkey as varchar) as fsc_section, cast(cast(o_totalprice as decimal(12, 2)) as varchar) as price,
    cast(o_orderkey % 40 as int) as page from orders where o_orderkey % 7 <> 0""")
def _(t):
    k = F.col("o_orderkey")
    codes = t("orders").select(
        F.element_at(F.array(F.lit("ON"), F.lit("BC"), F.lit("YT")), (k % 3).cast("int") + 1).alias("province"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" k"), k % 500, F.lit("\t"))).alias("fsc_code"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("fsc_fn"),
        F.lit(None).cast("string").alias("fsc_description"), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(12,2)"), F.lit(" ")).alias("price"), F.lit("").alias("chapter"), F.col("o_custkey").cast("string").alias("section"), (k % 40).alias("page_start"),
    )
    return ingest.normalised(codes).select("province", "fsc_code", "fsc_fn", "fsc_chapter", "fsc_section", "price", "page")


@query("hierarchy_path", """select c_custkey, concat_ws(' › ', nullif(r_name, ''), case when n_nationkey % 2 = 0 then n_name end, nullif(left(c_name, 12), '')) as path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def _(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", text.joined_nonblank(" › ", F.col("r_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(" "), text.truncated(F.col("c_name"), 12)).alias("path"))


@query("truncate_marker", "select doc_id, length(x) as n, md5(x) as digest from (select doc_id, case when length(text) > 24000 then left(text, 24000) || chr(10) || '[TRUNCATED]' else text end as x from documents)")
def _(t):
    x = text.truncated(F.col("text"), ingest.MAX_PROMPT, ingest.MARKER)
    return t("documents").select("doc_id", F.length(x).cast("long").alias("n"), F.md5(x).alias("digest"))


# --- de-duplication and aggregation


@query("dedup_first", "select doc_id, lang, source from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def _(t):
    return records.dedup_first(t("documents"), ["text"], ["doc_id"]).select("doc_id", "lang", "source")


@query("dedup_coalesce", """with d as (select d.*, quality, toxic from documents d left join labels l using (doc_id))
    select md5(text) as digest, min(doc_id) as doc_id, arg_min(source, doc_id) as source, arg_min(quality, doc_id) filter (where quality is not null) as quality, arg_min(toxic, doc_id) filter (where toxic is not null) as toxic from d group by text""")
def _(t):
    d = t("documents").select("doc_id", "text", "source").join(t("labels"), "doc_id", "left").withColumn("at", F.col("doc_id"))
    return records.dedup_coalesce(d, ["text"], "at", ["quality", "toxic"]).select(F.md5("text").alias("digest"), "doc_id", "source", "quality", "toxic")


@query("last_wins_index", "select user_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def _(t):
    return records.last_wins(t("events"), ["user_id"], "event_type", "event_id")


@query("distinct_codes", "select distinct p_brand as province, p_type as fsc_code from part where p_type <> ''")
def _(t):
    return lookup.distinct_codes(t("part").select(F.col("p_brand").alias("province"), F.col("p_type").alias("fsc_code")))


@query("sample_codes", "with d as (select distinct p_brand as province, p_name || ' ' || p_size as c from part), r as (select *, row_number() over (partition by province order by c) as rn from d) select province, string_agg(c, ',' order by c) as codes from r where rn <= 15 group by province")
def _(t):
    p = t("part").select(F.col("p_brand").alias("province"), F.concat_ws(" ", "p_name", "p_size").alias("fsc_code"))
    return lookup.sample_codes(p).select("province", F.array_join("codes", ",").alias("codes"))


@query("quality_counts", f"""with r as (select {PROV_SQL} as province, md5(text) as code, string_split(text, chr(10))[1] as fn, quality from documents left join labels using (doc_id))
    select province, count(*) as raw, count(distinct code) as unique_codes, count(*) filter (where coalesce(fn, '') = '') as missing_fn, count(*) filter (where quality is null) as missing_price from r group by province""")
def _(t):
    r = doc_records(t).join(t("labels").withColumnRenamed("doc_id", "record_id"), "record_id", "left")
    return metrics.quality_counts(r.select("province", F.md5("text").alias("fsc_code"), "fsc_fn", F.col("quality").cast("string").alias("price")))


@query("meta_confidence", """with p as (select p_partkey, case when p_size % 3 = 0 then '' else p_name end as fn, case when p_size % 5 = 0 then null else cast(p_size as varchar) end as price, case when p_size % 4 = 0 then '' else p_type end as d, p_brand, p_type from part)
    select p_partkey, case when fn <> '' and price is not null then 'high' when fn <> '' then 'medium' when d <> '' then 'low' else 'very_low' end as fsc_confidence,
      concat_ws('; ', 'chapter: ' || left(p_brand, 35), 'section: ' || left(p_type || ' ' || p_type || ' ' || p_type, 30), 'price: ' || price) as fsc_rationale, 'Page ' || p_partkey || ' | x0=' as fsc_key_observations from p""")
def _(t):
    p = t("part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("fsc_fn"), F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).alias("price"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type")).alias("fsc_description"),
        F.col("p_brand").alias("fsc_chapter"), F.concat_ws(" ", "p_type", "p_type", "p_type").alias("fsc_section"), F.lit("").alias("fsc_subsection"), F.col("p_partkey").alias("page"), F.lit(None).cast("double").alias("entry_x0"),
    )
    return ingest.with_meta(p).select("p_partkey", "fsc_confidence", "fsc_rationale", "fsc_key_observations")


@query("ordered_concat", "select conv_id, string_agg(text, ' ' order by turn, text) filter (where coalesce(text, '') <> '') as whole from conversations group by conv_id")
def _(t):
    c = t("conversations").groupBy("conv_id").agg(records.ordered_concat(F.col("text"), F.struct("turn", "text")).alias("whole"))
    return c.select("conv_id", text.nonblank("whole").alias("whole"))


@query("union_sources", "select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier")
def _(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return tables.union_sources(c, t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("except_done", "select o_orderkey, o_orderstatus from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def _(t):
    return pages.not_done(t("orders").select("o_orderkey", "o_orderstatus"), t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


# --- similarity and lookup

_REC_SQL = f"with r as (select doc_id as record_id, {PROV_SQL} as province, lang, {tokens_sql('text')} as t from documents)"
_SCORE_SQL = "case when len({a}) = 0 or len({b}) = 0 then 0.0 else 0.4 * (cast(len(list_intersect({a}, {b})) as double) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))) + 0.6 * (cast(len(list_intersect({a}, {b})) as double) / len({a})) end"


def _lookup_records(t) -> DataFrame:
    return doc_records(t).withColumn("tokens", text.tokens(F.col("text")))


@query("lookup_jaccard_topk", _REC_SQL + f""", a as (select * from r where province = 'ON' order by record_id limit 1), c as (select r.record_id, round({_SCORE_SQL.format(a='a.t', b='r.t')}, 4) as sim_score from r, a where r.province = 'BC')
    select record_id, sim_score, cast(row_number() over (order by sim_score desc, record_id) as int) as rank from c qualify rank <= 5""")
def lookup_jaccard_topk(t):
    r = _lookup_records(t)
    anchor = r.filter("province = 'ON'").orderBy("record_id").limit(1)
    return lookup.top_by_tokens(anchor, r.filter("province = 'BC'"), 5).select("record_id", "sim_score", "rank")


@query("anchor_lookup", f"with r as (select doc_id as record_id, {PROV_SQL} as province, string_split(text, ' ')[1] as code from documents) select record_id, province, code from r where province = 'YT' and upper({strip_sql('code')}) = 'THE' order by record_id limit 1")
def _(t):
    r = doc_records(t).withColumn("fsc_code", F.get(F.split("text", " "), F.lit(0)))
    return lookup.find_anchor(r, " the ", "YT").select("record_id", "province", F.col("fsc_code").alias("code"))


@query("fuzzy_search", "select p_partkey as record_id, p_name as name from part where p_brand = (select min(p_brand) from part) and (contains(upper(p_type), 'E') or contains(lower(p_name), 'e')) order by p_partkey limit 20")
def _(t):
    first = t("part").agg(F.min("p_brand").alias("province"))
    p = t("part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("province"), F.col("p_type").alias("fsc_code"), F.col("p_name").alias("fsc_fn")).join(F.broadcast(first), "province")
    return lookup.search_text(p.withColumn("province", F.lit("first")), "e", "first").select("record_id", F.col("fsc_fn").alias("name"))


def _names(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("province"), F.col("p_type").alias("fsc_code"), F.col("p_name").alias("fsc_fn"))


_SUBSTRING_SQL = "select doc_id as record_id, md5(text) as name from documents where contains(upper(source), '{u}') or contains(lower(text), '{l}') order by doc_id limit 200"


@query("fuzzy_search_all", "select p_partkey as record_id, p_name as name from part where contains(upper(p_type), 'E') or contains(lower(p_name), 'e') order by p_partkey limit 50")
def _(t):
    return lookup.search_text(_names(t), " e ", None, 50).select("record_id", F.col("fsc_fn").alias("name"))


@query("fuzzy_search_blank", "select p_partkey as record_id, p_name as name from part where false")
def _(t):
    return lookup.search_text(_names(t), "  ").select("record_id", F.col("fsc_fn").alias("name"))


@query("fuzzy_search_index", _SUBSTRING_SQL.format(u="LICENSE", l="license"))
def _(t):
    d = t("documents").select(F.col("doc_id").alias("record_id"), F.lit("all").alias("province"), F.col("source").alias("fsc_code"), F.col("text").alias("fsc_fn"))
    return substrings.SubstringIndex.build(d).search(" License ", None, 200).select("record_id", F.md5("fsc_fn").alias("name"))


@query("sorted_codes", "with c as (select distinct p_type as code from part where p_brand = (select min(p_brand) from part)) select code, cast(row_number() over (order by code) as int) as place from c")
def _(t):
    first = t("part").agg(F.min("p_brand")).first()[0]
    codes = lookup.Lookup(_blank_record(_names(t))).all_codes_for_province(first)
    return codes.groupBy().agg(F.collect_list("fsc_code").alias("codes")).select(F.posexplode("codes").alias("place", "code")).select("code", (F.col("place") + 1).alias("place"))


def _blank_record(df: DataFrame) -> DataFrame:
    blank = ["fsc_description", "fsc_section", "fsc_subsection", "fsc_chapter", "NGS_label"]
    return df.withColumns({c: F.lit("") for c in blank if c not in df.columns})


def _lookup_api(t) -> lookup.Lookup:
    """Documents as records: their number in the source as category, nations as categories."""
    r = doc_records(t).withColumns({"fsc_code": F.concat(F.lit("K"), "record_id"), "fsc_fn": F.col("text"), "NGS_code": F.concat(F.lit("n"), F.col("record_id") % 30)})
    dim = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("ngs_code"), F.col("n_name").alias("ngs_label"), F.concat(F.lit("region "), "n_regionkey").alias("ngs_description"), F.col("n_nationkey").alias("ord"))
    return lookup.Lookup(_blank_record(r.drop("fsc_description").withColumn("NGS_label", F.concat(F.lit("own "), F.col("NGS_code")))), categories=dim)


_LOOKUP_SQL = f"""with r as (select doc_id as record_id, {PROV_SQL} as province, 'K' || doc_id as code, 'n' || (doc_id % 30) as ngs, {tokens_sql("concat_ws(' | ', nullif(" + strip_sql("text") + ", ''), 'own n' || (doc_id % 30))")} as t from documents),
    a as (select * from r where province = 'ON' order by record_id limit 1),
    c as (select a.code as anchor_code, a.ngs as anchor_ngs, r.record_id, r.ngs, round({_SCORE_SQL.format(a='a.t', b='r.t')}, 4) as sim_score from r, a where r.province = 'BC'),
    top as (select *, cast(row_number() over (order by sim_score desc, record_id) as int) as rank from c qualify rank <= 5)
    """


@query("lookup_result", _LOOKUP_SQL + """select anchor_code, coalesce(n_name, 'own ' || anchor_ngs) as anchor_label, coalesce('region ' || n_regionkey, '') as anchor_description, record_id, rank, sim_score, ngs = anchor_ngs as ngs_match, 'jaccard' as score_method from top left join nation on anchor_ngs = 'n' || n_nationkey""")
def _(t):
    api = _lookup_api(t)
    code = api.records.filter("province = 'ON'").agg(F.min_by("fsc_code", "record_id")).first()[0]
    return api.search(code, "ON", "BC").select("anchor_code", "anchor_label", "anchor_description", "record_id", "rank", "sim_score", "ngs_match", "score_method")


@query("lookup_export", _LOOKUP_SQL + """select code as anchor_code, 'ANCHOR' as row_type, '1.000' as sim_score, 'jaccard' as score_method, code as fsc_code, 0 as rank from a
    union all select anchor_code, 'MATCH', printf('%.3f', sim_score), 'jaccard', 'K' || record_id, rank from top""")
def _(t):
    """The rows that an export shows of a search: one of the anchor, then its matches."""
    api = _lookup_api(t)
    first = api.records.filter("province = 'ON'").orderBy("record_id").limit(1).select("province", "fsc_code")
    found = api.export(first, "BC")
    return ingest.export_rows(found, "2024-01-31", ("rank",)).select("anchor_code", "row_type", "sim_score", "score_method", "fsc_code", "rank")


_VECTOR_SQL = """with s as (select a.vec_id as anchor_id, c.vec_id as record_id, list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double))) as s from embeddings a, embeddings c where a.label % 3 = 0 and c.label % 3 = 1)
    select anchor_id, record_id, round(s, 6) as sim_score, cast(row_number() over (partition by anchor_id order by s desc, record_id) as int) as rank from s qualify rank <= 3"""


@query("batch_lookup_vectors", _VECTOR_SQL)
def _(t):
    e = t("embeddings")
    return lookup.batch_by_vectors(e.filter("label % 3 = 0").select(F.col("vec_id").alias("anchor_id"), "embedding"), e.filter("label % 3 = 1").select(F.col("vec_id").alias("record_id"), "embedding"), 3).withColumn("sim_score", F.round("sim_score", 6))


@query("cosine_pairs", "select a.vec_id, b.vec_id as next_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double))), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(t):
    e = t("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", "next_id", F.round(scores.dot(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("l2_normalize", "with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 3) as v from embeddings), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from e) select vec_id, array_to_string(list_transform(v, lambda x: cast(cast(round(x / norm * 1000000) as bigint) as varchar)), ' ') as millionths from n")
def _(t):
    v = scores.l2_normalised(F.transform("embedding", lambda x: x.cast("double") * 3))
    return t("embeddings").select("vec_id", F.array_join(F.transform(v, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), " ").alias("millionths"))


@query("lookup_semantic_topk", """with a as (select * from embeddings where label % 3 = 0 order by vec_id limit 1), c as (select e.vec_id as record_id, list_sum(list_transform(list_zip(a.embedding, e.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double))) as s from embeddings e, a where e.label % 3 = 1)
    select record_id, round(s, 6) as sim_score, cast(row_number() over (order by s desc, record_id) as int) as rank from c qualify rank <= 5""")
def _(t):
    e = t("embeddings").withColumnRenamed("vec_id", "record_id")
    anchor = e.filter("label % 3 = 0").orderBy("record_id").limit(1)
    return lookup.top_by_vectors(anchor, e.filter("label % 3 = 1"), 5).select("record_id", F.round("sim_score", 6).alias("sim_score"), "rank")


@query("batch_lookup", f"with p as (select p_partkey, p_size, {tokens_sql('p_name')} as t from part), s as (select a.p_partkey as anchor_id, c.p_partkey as record_id, round({_SCORE_SQL.format(a='a.t', b='c.t')}, 4) as sim_score from p a, p c where a.p_size = 1 and c.p_size <> 1) select *, cast(row_number() over (partition by anchor_id order by sim_score desc, record_id) as int) as rank from s qualify rank <= 5")
def _(t):
    p = t("part").select("p_partkey", "p_size", text.tokens(F.col("p_name")).alias("tokens"))
    return lookup.batch_by_tokens(p.filter("p_size = 1").select(F.col("p_partkey").alias("anchor_id"), "tokens"), p.filter("p_size <> 1").select(F.col("p_partkey").alias("record_id"), "tokens"))


@query("rank_matches", """with m as (select l_partkey as anchor, l_suppkey as code, round(sum(l_quantity), 2) as score from lineitem group by all) select *, cast(row_number() over (partition by anchor order by score desc, code) as int) as rank from m qualify rank <= 10""")
def _(t):
    m = t("lineitem").groupBy(F.col("l_partkey").alias("anchor"), F.col("l_suppkey").alias("code")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return m.selectExpr("*", "cast(row_number() over (partition by anchor order by score desc, code) as int) as rank").filter("rank <= 10")


@query("category_flag", """with c as (select l_orderkey, l_linenumber, case when l_returnflag = 'A' then '' else l_returnflag end as a, case when l_linestatus = 'O' then 'N' else 'R' end as b from lineitem)
    select l_orderkey, l_linenumber, a not in ('', 'NOMAP') and a = b as ngs_match, case when a = '' then '' when a = b then 'same NGS' else 'diff NGS' end as flag from c""")
def _(t):
    c = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("a"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("b"))
    return c.select("l_orderkey", "l_linenumber", lookup.same_category(F.col("a"), F.col("b")).alias("ngs_match"), lookup.category_flag(F.col("a"), F.col("b")).alias("flag"))


@query("export_rows", """select p_brand as anchor_code, case when p_partkey % 4 = 0 then 'ANCHOR' else 'MATCH' end as row_type, case when p_partkey % 4 = 0 then '1.000' when p_size % 10 = 0 then '' else '0.' || lpad(cast(p_size as varchar), 2, '0') || '0' end as sim_score,
    'BC' as province, cast(p_partkey as varchar) as fsc_code, p_name as fsc_fn, cast(p_size as varchar) as page, '2024-01-31' as map_date, '' as fsc_notes from part""")
def _(t):
    p = t("part").select(
        F.col("p_brand").alias("anchor_code"), F.when(F.col("p_partkey") % 4 == 0, "ANCHOR").otherwise("MATCH").alias("row_type"), F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 100).alias("sim_score"), F.lit("BC").alias("province"),
        F.col("p_partkey").alias("fsc_code"), F.col("p_name").alias("fsc_fn"), F.col("p_size").alias("page"),
    )
    return ingest.export_rows(p, "2024-01-31").select("anchor_code", "row_type", "sim_score", "province", "fsc_code", "fsc_fn", "page", "map_date", "fsc_notes")


@query("province_list", f"select province, place from (select distinct {PROV_SQL} as province from documents) join (values ('ON', 1), ('BC', 2), ('YT', 3)) v(province, place) using (province)")
def _(t):
    return lookup.province_list(doc_records(t))


# --- classification


@query("role_lookup", """with i as (select r_name as province, cast(n_nationkey % 7 as varchar) as role, cast(n_nationkey as varchar) as ngs, n_nationkey as o from nation join region on n_regionkey = r_regionkey where n_nationkey % 4 <> 0),
    own as (select province, role, arg_max(ngs, o) as own from i group by all), a as (select role, arg_max(ngs, o) as shared from i group by role), regions as (select list(r_name order by r_regionkey) as names from region),
    c as (select c_custkey, coalesce(names[c_custkey % 7 + 1], 'NL') as province, cast(c_custkey % 11 as varchar) as role from customer, regions)
    select c_custkey, province, role, coalesce(own, shared) as role_ngs from c left join own using (province, role) left join a using (role)""")
def _(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    roles = n.select(F.col("r_name").alias("province"), (F.col("n_nationkey") % 7).cast("string").alias("role_code"), F.when(F.col("n_nationkey") % 4 != 0, F.array(F.col("n_nationkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("ngs_codes"), F.col("n_nationkey").alias("ord"))
    c = t("customer").select("c_custkey", (F.col("c_custkey") % 7).alias("r_regionkey"), (F.col("c_custkey") % 11).cast("string").alias("role")).join(t("region"), "r_regionkey", "left")
    return classify.role_lookup(c.select("c_custkey", F.coalesce("r_name", F.lit("NL")).alias("province"), "role"), roles).select("c_custkey", "province", "role", "role_ngs")


_RULES = [(r"\bpromo.*tin", "001.000", "tin"), (r"brass|steel", "002.000", "metal"), (r"\bsmall", "003.000", "small"), (r"ea\b", "004.000", "ending"), (r"o.e", "005.000", "o and e")]


def _rule_case(x: str, field: int) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, '(?i){r[0]}') then '{r[field]}'" for r in _RULES) + " end"


@query("keyword_rules", f"select p_partkey, {_rule_case('x', 1)} as ngs_code, {_rule_case('x', 2)} as rationale from (select p_partkey, p_type || ' ' || p_name as x from part)")
def _(t):
    at = rules.first_rule(F.concat_ws(" ", "p_type", "p_name"), _RULES)
    return t("part").select("p_partkey", at.alias("at")).select("p_partkey", rules.rule_field(F.col("at"), _RULES, 1).alias("ngs_code"), rules.rule_field(F.col("at"), _RULES, 2).alias("rationale"))


_ALL_RULE_TEXTS = ["Major consultation", "general assessment and consultation", "manuscript", "add-on tonsillectomy", "MRI of the knee", "evening premium", "x-ray", "lab test", "nothing of the kind", "C-section", "home visit", "bypass graft"]


@query("fee_keyword_rules", "with s as (select s_suppkey, list_extract([" + _in(_ALL_RULE_TEXTS) + f"], cast(s_suppkey % {len(_ALL_RULE_TEXTS)} as int) + 1) as x from supplier) select s_suppkey, x as name, case " + " ".join(f"when regexp_matches(x, '(?i){p}') then '{c}'" for p, c, _r in rules.KEYWORD_RULES) + " end as ngs_code from s")
def _(t):
    x = F.element_at(F.array(*map(F.lit, _ALL_RULE_TEXTS)), (F.col("s_suppkey") % len(_ALL_RULE_TEXTS)).cast("int") + 1)
    s = t("supplier").select("s_suppkey", x.alias("name"), rules.first_rule(x, rules.KEYWORD_RULES).alias("at"))
    return s.select("s_suppkey", "name", rules.rule_field(F.col("at"), rules.KEYWORD_RULES, 1).alias("ngs_code"))


@query("keyword_rules_texts", "select doc_id, case " + " ".join(f"when regexp_matches(text, '(?i){p}') then '{c}'" for p, c, _r in rules.KEYWORD_RULES) + " end as ngs_code from documents")
def _(t):
    d = t("documents").select("doc_id", rules.first_rule(F.col("text"), rules.KEYWORD_RULES).alias("at"))
    return d.select("doc_id", rules.rule_field(F.col("at"), rules.KEYWORD_RULES, 1).alias("ngs_code"))


@query("section_rules_texts", "select conv_id, turn, role, md5(text) as digest, case " + " ".join(f"when contains(upper(role || ' ' || text), '{k.upper()}') then '{c}'" for k, c in rules.SECTION_RULES) + " end as ngs_code from conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", "role", F.md5("text").alias("digest"), rules.section_category(F.col("role"), F.col("text")).alias("ngs_code"))


_SECTIONS = [f"Section {k}s" for k, _c in rules.SECTION_RULES] + ["Something else"]


@query("section_fallback", "with s as (select c_custkey, list_extract([" + _in(_SECTIONS) + f"], cast(c_custkey % {len(_SECTIONS)} as int) + 1) as section from customer) select c_custkey, section, case " + " ".join(f"when contains(upper(section || ' ' || c_custkey), '{k.upper()}') then '{c}'" for k, c in rules.SECTION_RULES) + " end as ngs_code from s")
def _(t):
    s = F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("c_custkey") % len(_SECTIONS)).cast("int") + 1)
    return t("customer").select("c_custkey", s.alias("section"), rules.section_category(s, F.col("c_custkey").cast("string")).alias("ngs_code"))


_SIM_SQL = f"""d as (select doc_id, {tokens_sql('text', text.STOP_CLASSIFY)} as t from documents), b as (select item_id, {tokens_sql('text', text.STOP_CLASSIFY)} as u from benchmark),
    sim as (select doc_id, item_id, len(list_intersect(t, u)) as n, len(t) as nt, len(u) as nu, list_sort(list_intersect(t, u)) as shared from d, b),
    sco as (select *, 0.35 * (cast(n as double) / (nt + nu - n)) + 0.65 * (cast(n as double) / nt) as score from sim where n > 0),
    best as (select doc_id, item_id, score, shared from sco where score >= 0.1 qualify row_number() over (partition by doc_id order by score desc, item_id) = 1)"""


@query("text_similarity_best", f"with {_SIM_SQL} select doc_id, item_id as best_item, round(score, 6) as score, array_to_string(shared[1:8], ' ') as shared from best")
def _(t):
    d = t("documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text"), text.STOP_CLASSIFY).alias("tokens"))
    b = t("benchmark").select(F.col("item_id").alias("other"), F.col("item_id").alias("ord"), text.tokens(F.col("text"), text.STOP_CLASSIFY).alias("tokens"))
    return classify.best_by_tokens(d, b).select(F.col("id").alias("doc_id"), F.col("other").alias("best_item"), F.round("score", 6).alias("score"), F.array_join(F.slice("shared", 1, 8), " ").alias("shared"))


_CASCADE_RULES = [(r"\blicense", "5", "licence line"), (r"^of\b", "6", "begins with of"), (r"\b[0-9]{5}\b", "7", "five digits")]
_CASCADE_SECTIONS = [("src3", "8"), ("fr", "9")]


def _cascade(t) -> DataFrame:
    k = F.col("doc_id")
    fees = t("documents").select(
        F.col("doc_id").alias("record_id"), province(F.col("source")).alias("province"), F.when(k % 3 == 0, F.concat(F.lit("A"), F.lpad((k % 1000).cast("string"), 3, "0"), (k % 10).cast("string"))).otherwise(F.concat(F.lit("A"), (k % 10).cast("string"))).alias("fsc_code"),
        F.col("text").alias("fsc_fn"), F.lit("").alias("fsc_description"), F.col("source").alias("fsc_section"), F.col("lang").alias("fsc_chapter"),
    )
    categories = t("benchmark").select(F.col("item_id").cast("string").alias("ngs_code"), F.concat(F.lit("item "), "item_id").alias("ngs_label"), F.col("text").alias("ngs_description"), F.col("item_id").alias("ord"))
    roles = t("region").select(F.lit("ON").alias("province"), F.col("r_regionkey").cast("string").alias("role_code"), F.array(F.col("r_regionkey").cast("string")).alias("ngs_codes"), F.col("r_regionkey").alias("ord"))
    return classify.cascade(fees, categories, roles, _CASCADE_RULES, _CASCADE_SECTIONS)


_CASCADE_SQL = f"""with f as (select doc_id as record_id, {PROV_SQL} as province, case when doc_id % 3 = 0 then 'A' || lpad(cast(doc_id % 1000 as varchar), 3, '0') || (doc_id % 10) else 'A' || (doc_id % 10) end as code,
      text || '  ' || source || ' ' || lang as x, upper(source || ' ' || lang) as s from documents),
    ro as (select *, case when province = 'ON' then case when length(code) >= 5 then substr(code, 5, 1) else 'A' end else '' end as role from f),
    h as (select ro.*, cast(r_regionkey as varchar) as role_ngs, case {' '.join(f"when regexp_matches(x, '(?i){p}') then '{c}'" for p, c, _r in _CASCADE_RULES)} end as kw, case when contains(s, 'SRC3') then '8' when contains(s, 'FR') then '9' end as sec from ro left join region on role = cast(r_regionkey as varchar)),
    d as (select record_id as doc_id, {tokens_sql('x', text.STOP_CLASSIFY)} as t from f), b as (select item_id, {tokens_sql("'item ' || item_id || ' ' || text", text.STOP_CLASSIFY)} as u from benchmark),
    sim as (select doc_id, item_id, len(list_intersect(t, u)) as n, len(t) as nt, len(u) as nu from d, b),
    sco as (select *, 0.35 * (cast(n as double) / (nt + nu - n)) + 0.65 * (cast(n as double) / nt) as score from sim where n > 0),
    best as (select doc_id, item_id, score from sco where score >= 0.1 qualify row_number() over (partition by doc_id order by score desc, item_id) = 1),
    m as (select record_id, coalesce(role_ngs, kw, cast(item_id as varchar), sec, '') as NGS_code,
      case when role_ngs is not null or kw is not null then 'high' when item_id is not null then case when score >= 0.55 then 'high' when score >= 0.3 then 'medium' when score >= 0.15 then 'low' else 'very_low' end when sec is not null then 'low' else 'very_low' end as NGS_confidence,
      case when role_ngs is not null then 'role_code_table' when kw is not null then 'keyword_rule' when item_id is not null then 'text_similarity' when sec is not null then 'section_fallback' else '' end as match_method,
      case when role_ngs is not null then 1.0 when kw is not null then 0.9 when item_id is not null then round(round(score, 4), 3) when sec is not null then 0.2 else 0.0 end as match_score from h left join best on doc_id = record_id)"""


@query("cascade_classify", _CASCADE_SQL + " select record_id, NGS_code, case when NGS_code = '' then '' else coalesce('item ' || item_id, '') end as NGS_label, NGS_confidence, match_method, match_score from m left join benchmark on cast(item_id as varchar) = NGS_code")
def _(t):
    return _cascade(t).select("record_id", "NGS_code", "NGS_label", "NGS_confidence", "match_method", F.round("match_score", 3).alias("match_score"))


@query("method_breakdown", _CASCADE_SQL + " select coalesce(nullif(match_method, ''), 'none') as match_method, count(*) as n from m group by 1")
def _(t):
    return metrics.method_breakdown(_cascade(t))


@query("confidence_summary", _CASCADE_SQL + """ select count(*) filter (where NGS_confidence = 'high') as high, count(*) filter (where NGS_confidence = 'medium') as medium, count(*) filter (where NGS_confidence in ('low', 'very_low')) as low,
    count(*) filter (where NGS_code = '') as unassigned, count(*) as total from m""")
def _(t):
    return metrics.confidence_summary(_cascade(t))


@query("dim_left_lookup", "select c_custkey, n_name as label from customer left join (select * from nation where n_nationkey % 3 <> 0) on c_nationkey = n_nationkey")
def _(t):
    dim = t("nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("ngs_code"), F.col("n_name").alias("ngs_label"), F.col("n_nationkey").alias("ord"))
    return classify.with_label(t("customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey", "label").select("c_custkey", "label")


# --- linking


def _link_records(t) -> DataFrame:
    return _lookup_records(t).select("record_id", "province", "bucket", "tokens", F.concat(F.lit("D"), "record_id").alias("fsc_code"))


@query("bucket_pairs", _REC_SQL + f""", f as (select lang, province, min(record_id) as first from r group by all), p as (select a.lang as bucket, a.record_id as left_id, b.record_id as right_id, len(a.t) as na, len(b.t) as nb, len(list_intersect(a.t, b.t)) as n
      from r a join f fa on a.lang = fa.lang and a.province = fa.province join f fb on fa.lang = fb.lang and fa.first < fb.first join r b on b.lang = fb.lang and b.province = fb.province
      where len(a.t) + len(b.t) = 0 or (len(a.t) > 0 and len(b.t) >= 0.55 * len(a.t) - 1e-9)),
    s as (select *, case when na + nb = 0 then 0.05 else 0.4 * (cast(n as double) / (na + nb - n)) + 0.6 * (cast(n as double) / na) end as score from p)
    select bucket, left_id, right_id, case when na + nb = 0 then 0.05 else round(score, 6) end as score from s where na + nb = 0 or score >= 0.55""")
def _(t):
    return link.bucket_pairs_dense(_link_records(t)).select("bucket", "left_id", "right_id", F.round("score", 6).alias("score"))


def _keyed(t) -> DataFrame:
    r = _link_records(t)
    return link.top_keys(r.drop("tokens"), link.greedy_groups(link.bucket_pairs_dense(r, every_blank=False), r))


#: The fold in SQL: a recursion that takes the pairs of each bucket in order, with the members known so far as a list.
_GROUPS_SQL = _REC_SQL.replace("with r as", "with recursive r as") + """, f as (select lang, province, min(record_id) as first from r group by all), pl as (select *, row_number() over (partition by lang order by first) as place from f),
    q as (select r.*, place from r join pl using (lang, province)),
    p as (select a.lang as bucket, a.record_id as left_id, b.record_id as right_id, a.province as lp, b.province as rp, a.place as la, b.place as lb, len(a.t) as na, len(b.t) as nb, len(list_intersect(a.t, b.t)) as n
      from q a join q b on a.lang = b.lang and a.place < b.place where len(a.t) + len(b.t) = 0 or (len(a.t) > 0 and len(b.t) >= 0.55 * len(a.t) - 1e-9)),
    s as (select *, case when na + nb = 0 then 0.05 else 0.4 * (cast(n as double) / (na + nb - n)) + 0.6 * (cast(n as double) / na) end as score from p),
    o as (select *, row_number() over (partition by bucket order by score desc, la, lb, left_id, right_id) as i from s where na + nb = 0 or score >= 0.55),
    g(bucket, i, m) as (select distinct bucket, cast(0 as bigint), cast([] as struct(r bigint, g bigint, p varchar)[]) from o union all
      select bucket, i + 1, case when ga is null and gb is null then m || [{'r': left_id, 'g': no, 'p': lp}, {'r': right_id, 'g': no, 'p': rp}]
          when ga is null and not list_contains(list_transform(list_filter(m, lambda x: x.g = gb), lambda x: x.p), lp) then m || [{'r': left_id, 'g': gb, 'p': lp}]
          when gb is null and not list_contains(list_transform(list_filter(m, lambda x: x.g = ga), lambda x: x.p), rp) then m || [{'r': right_id, 'g': ga, 'p': rp}] else m end
      from (select g.bucket, g.i, g.m, o.left_id, o.right_id, o.lp, o.rp, list_filter(m, lambda x: x.r = o.left_id)[1].g as ga, list_filter(m, lambda x: x.r = o.right_id)[1].g as gb,
          coalesce(list_max(list_transform(m, lambda x: x.g)), 0) + 1 as no from g join o on o.bucket = g.bucket and o.i = g.i + 1)),
    groups as (select bucket, x.r as record_id, x.g as group_no from (select bucket, unnest(m) as x from g qualify row_number() over (partition by bucket order by i desc) = 1)),
    keyed as (select record_id, province, 'D' || record_id as fsc_code, lang || '_' || printf('%04d', coalesce(group_no, coalesce(base, 0) + row_number() over (partition by lang, group_no is null order by record_id))) as top_key
      from r left join groups using (record_id) left join (select bucket, max(group_no) as base from groups group by bucket) on bucket_1 = lang)""".replace("on bucket_1 = lang", "b on b.bucket = lang")


@query("greedy_groups", _GROUPS_SQL + " select bucket, record_id, group_no from groups")
def _(t):
    r = _link_records(t)
    return link.greedy_groups(link.bucket_pairs_dense(r, every_blank=False), r)


@query("top_keys", _GROUPS_SQL + " select record_id, province, top_key from keyed")
def _(t):
    return _keyed(t).select("record_id", "province", "top_key")


@query("group_size_stats", _GROUPS_SQL + " select count(*) as groups, count(*) filter (where n > 1) as cross_groups, count(*) filter (where n = 1) as singletons, max(n) as largest from (select count(*) as n from keyed group by top_key)")
def _(t):
    return link.group_sizes(_keyed(t))


@query("group_sample", _GROUPS_SQL + """ select top_key, count(*) as n, count(distinct province) as provinces, '[' || string_agg('{"province":"' || province || '","fsc_code":"' || fsc_code || '"}', ',' order by province, fsc_code) || ']' as members
    from keyed group by top_key having count(*) between 2 and 4 and count(distinct province) >= 2 order by top_key limit 8""")
def _(t):
    return link.sample_groups(_keyed(t)).select("top_key", "n", "provinces", F.to_json("members").alias("members"))


# --- lines and reference documents


@query("explode_lines", f"select doc_id, cast(line_no as int) as line_no, text from {LINES_SQL}")
def _(t):
    return doc_lines(t)


@query("span_to_line", """select conv_id as page, string_agg(text, '' order by turn, text) as text, round(min_by(turn + 0.125, turn), 2) as x0, max(length(text)) as font_size from conversations where coalesce(trim(text), '') <> '' group by conv_id""".replace("min_by", "arg_min"))
def _(t):
    spans = t("conversations").select(F.col("conv_id").alias("page"), F.struct("turn", "text").alias("span"), "text", (F.col("turn") + 0.125).alias("x0"), F.lit(0.0).alias("y0"), F.length("text").alias("size"), F.col("role").alias("font"))
    out = layout.spans_to_lines(spans, ["page"])
    return out.select("page", "text", "x0", F.col("font_size").cast("long").alias("font_size"))


@query("filter_index_pages", "select page_id as page, length(html) as n from pages where page_id < 829")
def _(t):
    return layout.before_index(t("pages").select(F.col("page_id").alias("page"), "html")).select("page", F.length("html").cast("long").alias("n"))


@query("carry_forward", f"select doc_id, cast(line_no as int) as line_no, coalesce(last_value(case when line_no % 5 = 0 then text when line_no % 7 = 3 then '' end ignore nulls) over (partition by doc_id order by line_no), '') as section from {LINES_SQL}")
def _(t):
    event = F.when(F.col("line_no") % 5 == 0, F.col("text")).when(F.col("line_no") % 7 == 3, "")
    return doc_lines(t).select("doc_id", "line_no", records.carried(event, ["doc_id"], ["line_no"]).alias("section"))


@query("segment_records", "select user_id, event_id, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as segment from events")
def _(t):
    return t("events").select("user_id", "event_id", records.segment(F.col("event_type") == "purchase", ["user_id"], ["event_id"]).alias("segment"))


@query("first_eligible", f"select doc_id, cast(min(line_no) as int) as line_no, arg_min(text, line_no) as text from {LINES_SQL} where length(text) > 100 group by doc_id")
def _(t):
    long = doc_lines(t).filter(F.length("text") > 100)
    return long.groupBy("doc_id").agg(F.min("line_no").alias("line_no"), records.first_in_order(F.col("text"), F.col("line_no")).alias("text"))


@query("first_nonnull_price", "select o_custkey, arg_min(case when o_orderstatus <> 'O' then o_totalprice end, o_orderkey) filter (where o_orderstatus <> 'O') as price from orders group by o_custkey")
def _(t):
    price = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice"))
    return t("orders").groupBy("o_custkey").agg(records.first_in_order(price, F.col("o_orderkey")).alias("price"))


#: By province: what stands at the places of a document's lines, as SQL that both engines read: code, text of other lines, x0, size.
_HEAD = "translate(regexp_replace(text, '[^ -~]', ''{g}), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_LAYOUTS = {
    "ON": (
        "'K' || lpad(cast(line_no % 1000 as varchar(9)), 3, '0')", "",
        "case when line_no % 6 = 0 then 43.0 when line_no % 6 = 3 then 400.0 when line_no % 34 = 1 then 90.0 when line_no % 17 = 1 then 50.0 else 70.0 end", "case when line_no % 17 = 1 then 18.0 else 12.0 end",
    ),
    "BC": (
        "lpad(cast(line_no % 100000 as varchar(9)), 5, '0')",
        "when line_no % 23 = 5 then 'Medical Services Commission ' || case line_no % 4 when 0 then 'Diagnostic' when 1 then 'Surgery' when 2 then 'Obstetrics' else 'Part' end",
        "case when line_no % 6 = 0 then 70.0 when line_no % 6 = 3 then 450.0 when line_no % 23 = 5 then 72.0 when line_no % 34 = 1 then 60.0 when line_no % 17 = 1 then 100.0 else 120.0 end",
        "case when line_no % 34 = 1 then 12.0 when line_no % 5 = 4 and line_no % 6 <> 0 then 9.0 else 10.0 end",
    ),
    "YT": (
        "lpad(cast(line_no % 10000 as varchar(9)), 4, '0')", "when line_no % 23 = 5 then text || ':'",
        "case when line_no % 6 = 0 then 40.0 when line_no % 6 = 3 then 400.0 when line_no % 17 = 1 or line_no % 23 = 5 then 50.0 else 95.0 end", "case when line_no % 34 = 1 then 14.0 else 9.0 end",
    ),
}


def _made_line(province_code: str, every: str) -> tuple[str, str, str]:
    """SQL of a line's text, x0 and font size. every: what regexp_replace needs to replace all (an argument, in one engine)."""
    code, more, x0, size = _LAYOUTS[province_code]
    made = f"case when line_no % 6 = 0 then {code} || ' ' || text || ' .... 12.34' {more} when line_no % 17 = 1 then {_HEAD.format(g=every)} when line_no % 6 = 3 then cast(line_no + 10 as varchar(9)) || '.50' else text end"
    return made, x0, size


def _layout_query(province_code: str, range_pages: int = layout.RANGE_PAGES):
    """Lines of the documents with codes and places that follow from line_no."""

    def run(t):
        made, x0, size = _made_line(province_code, "")
        lines = doc_lines(t).selectExpr("doc_id", f"'{province_code}' as province", "cast(floor(line_no / 40) as int) as page", "line_no", f"{made} as text", f"cast({x0} as double) as x0", f"cast({size} as double) as font_size")
        return layout.post_process(layout.parse_layout(lines, ["doc_id", "province"], range_pages)).drop("line_no", "fsc_others")

    return run


def _layout_sql(province_code: str) -> str:
    """The parser in SQL, written apart from the operator: classes of lines, segments, names and prices by windows."""
    made, x0, size = _made_line(province_code, ", 'g'")
    clean = CLEAN_SQL.replace("translate(text,", "translate(made,")
    leaders = lambda x: rf"trim(regexp_replace({x}, '\.{{3,}}', ' ', 'g'), ' .-')"
    ends = rf"\$?(\d{{1,6}}\.\d{{2}}){text.SPACE}*$"
    price, bare = (lambda x: f"nullif(regexp_extract({x}, '{ends}', 1), '')"), (lambda x: leaders(f"regexp_replace({x}, '{ends}', '')"))
    upper = r"coalesce(len(regexp_extract_all(t, '\p{Lu}')) / nullif(len(regexp_extract_all(t, '\p{L}')), 0) > 0.8, false)"
    has = lambda p, x="t": f"regexp_matches({x}, '{p}')"
    amount = has(layout.PRICE_ONLY)
    none, blank = "cast(null as varchar)", "''"
    if province_code == "ON":
        heading = f"not {has(layout.ON_CODE)} and not {has(layout.ON_HASH)} and length(t) > 4 and {upper} and len(string_split(t, ' ')) <= 18"
        kind = f"""case when {has(layout.ON_SKIP)} then 'none' when (x0 < 45 and {has(layout.ON_HASH)}) or (x0 < 60 and {has(layout.ON_CODE)}) then 'code' when {has(r'^[A-Z]{1,3}\d+\s*$')} then 'none'
            when x0 > 85 and size >= 14 and {heading} then 'chapter' when x0 < 65 and size >= 10 and {heading} then 'close' when {amount} and x0 > 350 then 'price' when {has(r'^\d{1,2}$')} and x0 > 380 then 'none' else 'body' end"""
        opens, note, name, margin, splits = layout.ON_CODE, has(layout.ON_NOTE, "lower(body)"), "x0 >= 60 and not note", "x0 < 60 and not note", "true"
        chapter = "case when kind = 'chapter' then case " + " ".join(f"when contains(upper(replace(t, ' ', '')), '{k}') then '{v}'" for k, v in rules.ON_CHAPTERS) + " else upper(replace(t, ' ', '')) end end"
        section, sub = "case when kind = 'close' then t end", none
    elif province_code == "BC":
        kind = f"""case when {has(r'^\d+-\d+$')} or t in ('$', 'Anes.', 'Level', 'Anes') then 'none' when contains(t, 'Medical Services Commission') and x0 < 82 then 'chapter' when {amount} and x0 > 400 then 'price'
            when size > 10.4 and x0 < 82 then 'close' when x0 > 80 and x0 < 115 and size >= 9.5 then 'sub' when x0 > 60 and x0 < 82 and size > 9.5 and size < 10.4 and {has(layout.BC_CODE)} then 'code' when x0 > 115 then 'body' else 'none' end"""
        opens, note, name, margin, splits = layout.BC_CODE, f"size < 9.7 or {has(layout.BC_NOTE, 'lower(body)')}", "size >= 9.7 and not starts_with(lower(body), 'note')", "false", "true"
        chapter = "case when kind = 'chapter' then case " + " ".join(f"when contains(t, '{c}') then '{c}'" for c in rules.BC_CHAPTERS) + " end end"
        section, sub = "case when kind = 'close' then t end", f"case kind when 'close' then {blank} when 'sub' then t end"
    else:
        closes = f"x0 <= 55 and size <= 12 and not {has(layout.YT_CODE)} and {has(r'\p{L}')} and ({upper} or ends_with(t, ':'))"
        kind = f"""case when {has(layout.YT_SKIP)} then 'none' when {amount} and x0 > 350 then 'price' when size >= 14 then 'close' when {closes} then 'close'
            when {has(layout.YT_CODE)} and x0 between 35 and 80 and size < 11 then 'code' when x0 >= 90 then 'body' else 'none' end"""
        opens, note, name, margin, splits = layout.YT_CODE, has(layout.YT_NOTE, "lower(body)"), "not note", "false", "false"
        chapter, section = "case when kind = 'close' and size >= 14 then t end", f"case when kind = 'close' and size >= 14 then {blank} when kind = 'close' and {upper} then rtrim(t, ':') end"
        sub = f"case when kind = 'close' and (size >= 14 or {upper}) then {blank} when kind = 'close' then rtrim(t, ':') end"
    rest = strip_sql(f"regexp_replace(t, '{opens}', '')")
    so_far, ordered = "over (partition by doc_id order by line_no)", "over (partition by doc_id, seg order by line_no)"
    names = "case " + " ".join(f"when trim(fsc_chapter) = '{k}' then '{v}'" for k, v in rules.CHAPTER_NAMES.items()) + " else trim(fsc_chapter) end"
    tail = rf"{text.SPACE}+\$?(\d{{1,6}}\.\d{{2}}){text.SPACE}*$"
    return f"""with a as (select doc_id, line_no, cast(line_no // 40 as int) as page, {made} as made, cast({x0} as double) as x0, cast({size} as double) as size from {LINES_SQL}),
    b as (select *, {clean} as t from a), c as (select *, {kind} as kind, {leaders('t')} as body from b where t <> '' {"and page < 829" if province_code == "ON" else ""}), d as (select *, {note} as note from c),
    e as (select *, {name} as can_name, {margin} as margin, sum(case when kind in ('code', 'close') then 1 else 0 end) {so_far} as seg,
      coalesce(last_value({chapter} ignore nulls) {so_far}, '') as chapter, coalesce(last_value({section} ignore nulls) {so_far}, '') as section, coalesce(last_value({sub} ignore nulls) {so_far}, '') as sub,
      case when kind = 'code' then {bare(rest)} end as title0, case when kind = 'code' then {price(rest)} end as price0 from d),
    f as (select *, max(case when kind in ('code', 'close') then kind end) over (partition by doc_id, seg) as head, max(title0) over (partition by doc_id, seg) as title from e),
    g as (select *, kind = 'body' and can_name and title = '' and sum(case when kind = 'body' and can_name then 1 else 0 end) {ordered} = 1 as waited from f where head = 'code' and kind in ('code', 'price', 'body')),
    h as (select *, case when waited and {splits} then {bare('body')} else body end as value from g),
    i as (select *, case when title = '' and (waited or (kind = 'body' and margin)) then nullif(value, '') end as candidate from h),
    j as (select *, count(candidate) {ordered} as named from i),
    k as (select *, candidate is not null and named = 1 as names, kind = 'body' and note and not waited as noted,
      case when kind = 'code' then price0 when kind = 'price' then ltrim(t, '$') when waited and {splits} and named - (case when candidate is null then 0 else 1 end) = 0 then {price('body')} end as price from j),
    r as (select doc_id, max(case when kind = 'code' then regexp_extract(t, '{opens}', 1) end) as fsc_code, coalesce(nullif(max(title), ''), max(value) filter (where names), '') as fsc_fn, max(chapter) filter (where kind = 'code') as fsc_chapter,
      max(section) filter (where kind = 'code') as fsc_section, max(sub) filter (where kind = 'code') as fsc_subsection, coalesce(string_agg(value, ' ' order by line_no) filter (where kind = 'body' and not noted and not names and value <> ''), '') as fsc_description,
      coalesce(string_agg(body, ' ' order by line_no) filter (where noted and body <> ''), '') as fsc_notes, arg_min(price, line_no) filter (where price is not null) as price, max(page) filter (where kind = 'code') as page, max(x0) filter (where kind = 'code') as entry_x0
      from k group by doc_id, seg),
    z as (select *, nullif(regexp_extract(fsc_fn, '{tail}', 1), '') as found from r)
    select doc_id, '{province_code}' as province, fsc_code, {strip_sql(f"case when found is not null then trim(regexp_replace(fsc_fn, '{tail}', ''), ' .') else fsc_fn end")} as fsc_fn,
      {strip_sql(f"case when regexp_matches({names}, '^,?GP[0-9]') then 'GP – General Preamble' else {names} end")} as fsc_chapter, {strip_sql('fsc_section')} as fsc_section, {strip_sql('fsc_subsection')} as fsc_subsection,
      {strip_sql('fsc_description')} as fsc_description, {strip_sql('fsc_notes')} as fsc_notes, case when found is not null then coalesce(nullif(price, ''), found) else price end as price, page, entry_x0 from z"""


for _province in _LAYOUTS:
    query(f"layout_{_province.lower()}", _layout_sql(_province))(_layout_query(_province))


@query("adjacent_dedup", "with c as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn, role) as before from conversations) select conv_id, string_agg(role, ',' order by turn, role) as roles from c where before is null or before <> role group by conv_id")
def _(t):
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    return t("conversations").groupBy("conv_id").agg(roles.alias("roles")).select("conv_id", F.array_join(reference_docs.adjacent_dedup(F.col("roles")), ",").alias("roles"))


@query("zip_header_map", "select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment else c_name end as a, cast(c_nationkey as varchar) as b from customer")
def _(t):
    row = F.when(F.col("c_custkey") % 2 == 0, F.array(F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.lit("more"))).otherwise(F.array(F.col("c_name"), F.col("c_nationkey").cast("string")))
    m = reference_docs.header_map(F.array(F.lit("a"), F.lit("b"), F.lit("a")), row)
    return t("customer").select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("sectioned_rows", rf"""with l as (select doc_id, line_no, text, line_no % 9 = 0 as heading, line_no % 9 <> 0 and regexp_matches(text, '^([A-Z][a-z]+) (.*)$') and line_no % 3 = 1 as opens from {LINES_SQL}),
    s as (select *, sum(case when heading or opens then 1 else 0 end) over (partition by doc_id order by line_no) as seg, coalesce(last_value(case when heading then text end ignore nulls) over (partition by doc_id order by line_no), '') as section from l)
    select doc_id, max(case when opens then regexp_extract(text, '^([A-Z][a-z]+) (.*)$', 1) end) as code, md5(max(case when opens then regexp_extract(text, '^([A-Z][a-z]+) (.*)$', 2) end)) as label, md5(max(section)) as section,
      md5(coalesce(string_agg(text, ' ' order by line_no) filter (where not opens and not heading and text <> ''), '')) as description from s group by doc_id, seg having count(*) filter (where opens) > 0""")
def _(t):
    lines = doc_lines(t).withColumnRenamed("line_no", "ord").withColumn("third", F.col("ord") % 3 == 1)
    # only every third line may open a row: the others get a mark that the pattern doesn't take
    marked = lines.withColumn("text", F.when((F.col("ord") % 9 != 0) & ~F.col("third"), F.concat(F.lit("\x01"), "text")).otherwise(F.col("text")))
    rows = reference_docs.sections(marked, F.col("ord") % 9 == 0, r"^([A-Z][a-z]+) (.*)$", ["doc_id"])
    bare = F.ltrim(F.replace(F.replace(F.concat(F.lit(" "), "description"), F.lit(" \x01"), F.lit(" ")), F.lit("  "), F.lit("  ")), F.lit("\x02"))
    return rows.select("doc_id", "code", F.md5("label").alias("label"), F.md5("section").alias("section"), F.md5(F.substring(bare, 2, 1 << 30)).alias("description"))


@query("route_case", """select p_partkey, case when p_partkey % 4 = 0 then 'ccp' when p_partkey % 4 = 1 then 'role' when p_partkey % 4 = 2 then 'fsc' end as kind from part""")
def _(t):
    heads = [["CCP Modifier", "Role Code"], ["Role Code", "FSC Code"], ["x", "FSC Code"], ["p", "q"]]
    h = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in heads]), (F.col("p_partkey") % 4).cast("int") + 1)
    return t("part").select("p_partkey", reference_docs.table_kind(h).alias("kind"))


# --- windows and resuming


_WINDOWS_SQL = """n as (select conv_id, max(turn) + 1 as n from conversations group by conv_id), s as (select conv_id, n, unnest(range(0, n, 2)) as start from n), w as (select conv_id, start, unnest(range(start, least(start + 3, n))) as page from s)"""


@query("sliding_page_windows", f"with {_WINDOWS_SQL} select conv_id, cast(start as int) as start, cast(page as int) as page, start = 0 or page >= start + 1 as new from w")
def _(t):
    return pages.page_windows(t("conversations"), "conv_id", "turn", 3, 2)


@query("page_latest_wins", "select user_id, event_type, arg_max(value, (ts, value)) as value from events where value is not null group by all".replace("(ts, value)", "{'t': ts, 'v': value}"))
def _(t):
    return pages.latest_wins(t("events").filter("value is not null"), ["user_id", "event_type"], "value", "ts")


@query("json_extract_permissive", """select event_type as province, cast(event_id as int) as page_start, 'K' || event_id as fsc_code, 'ch' || (event_id % 5) as chapter, case when event_id % 3 = 0 then 'own' else 'sec' end as section from events where event_id % 10 <> 0""")
def _(t):
    code = F.concat(F.lit('{"fsc_code":"K'), "event_id", F.lit('","section":"'), F.when(F.col("event_id") % 3 == 0, "own").otherwise(""), F.lit('"}'))
    raw = F.when(F.col("event_id") % 10 == 0, "{not json").otherwise(F.concat(F.lit('{"chapter":"ch'), F.col("event_id") % 5, F.lit('","section":"sec","codes":['), code, F.lit("]}")))
    w = ingest.parsed_windows(t("events").select(F.col("event_type").alias("province"), F.col("event_id").cast("int").alias("start"), raw.alias("raw")))
    return ingest.window_codes(w).select("province", "page_start", "fsc_code", "chapter", "section")


@query("json_props", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k INT", {"mode": "PERMISSIVE"})["k"].alias("k"))


_HINT_SQL = r"case when o_orderkey % 2 = 0 then 'K' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') || ' S' || lpad(cast(o_orderkey % 10000 as varchar), 5, '0') || ' ' || lpad(cast(o_orderkey % 100000 as varchar), 5, '0') else 'no codes ' || o_orderpriority end"


@query("code_hint_windows", rf"select o_orderkey, len(regexp_extract_all({_HINT_SQL}, '\b[A-Z]\d{{4,}}\b|\b\d{{5}}\b|\bV\d{{5}}\b|\b[A-Z]\d{{3}}\b')) as hints from orders")
def _(t):
    k = F.col("o_orderkey")
    pad = lambda n, size: F.lpad((k % n).cast("string"), size, "0")
    x = F.when(k % 2 == 0, F.concat(F.lit("K"), pad(1000, 3), F.lit(" S"), pad(10000, 5), F.lit(" "), pad(100000, 5))).otherwise(F.concat(F.lit("no codes "), "o_orderpriority"))
    return t("orders").select("o_orderkey", text.code_hints(x).cast("long").alias("hints"))


@query("zero_windows", "select conv_id, cast(turn as int) as start, 2 as hints from (select distinct conv_id, turn from conversations where turn % 2 = 0 and turn % 4 <> 0)")
def _(t):
    c = t("conversations").select("conv_id", F.col("turn").cast("int").alias("start")).distinct()
    texts = c.withColumn("text", F.concat(F.lit("see K"), F.lpad((F.col("start") % 1000).cast("string"), 3, "0"), F.lit(" and 12345")))
    return pages.zero_windows(texts, c.filter("start % 2 = 0"), c.filter("start % 4 = 0"), "conv_id", 2)


@query("zero_windows_texts", rf"with w as (select conv_id, turn, string_agg(coalesce(text, ''), chr(10) order by text) as x from conversations group by all) select conv_id, cast(turn as int) as start, hints from (select *, len(regexp_extract_all(x, '{text.CODE_HINT}')) as hints from w) where turn % 2 = 0 and turn % 4 <> 0 and hints >= 0")
def _(t):
    c = t("conversations").withColumn("start", F.col("turn").cast("int"))
    texts = c.groupBy("conv_id", "start").agg(F.array_join(F.sort_array(F.collect_list(text.text_or_blank("text"))), "\n").alias("text"))
    keys = texts.select("conv_id", "start")
    return pages.zero_windows(texts, keys.filter("start % 2 = 0"), keys.filter("start % 4 = 0"), "conv_id", 0).withColumn("hints", F.col("hints").cast("long"))


@query("resume_anti_join", f"with {_WINDOWS_SQL} select distinct conv_id, cast(start as int) as start from w where not exists (select 1 from conversations c where c.conv_id = w.conv_id and c.turn = w.start and c.role = 'assistant')")
def _(t):
    w = pages.page_windows(t("conversations"), "conv_id", "turn", 3, 2).select("conv_id", "start").distinct()
    done = t("conversations").filter("role = 'assistant'").select("conv_id", F.col("turn").cast("int").alias("start"))
    return pages.not_done(w, done, ["conv_id", "start"])


@query("window_texts", f"with {_WINDOWS_SQL} select conv_id, cast(start as int) as start, md5(string_agg(coalesce(text, ''), chr(10) order by page, text)) as digest from w left join conversations c using (conv_id) where c.turn = w.page group by conv_id, start")
def _(t):
    w = pages.page_windows(t("conversations"), "conv_id", "turn", 3, 2)
    return pages.window_texts(w, t("conversations"), "conv_id", "turn", "text").select("conv_id", "start", F.md5("text").alias("digest"))


@query("codes_per_window", "select o_orderpriority as province, cast(o_custkey % 50 as int) as start, count(*) as n from orders where o_custkey % 50 <> 7 group by all")
def _(t):
    o = t("orders").select(F.col("o_orderpriority").alias("province"), F.when(F.col("o_custkey") % 50 != 7, (F.col("o_custkey") % 50).cast("int")).alias("page_start"))
    return metrics.codes_per_window(o)
