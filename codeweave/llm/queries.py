"""The queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, decontamination, fingerprints, jaccard_join, packing, sharding, substring_dedup, token_alignment, token_counts, toxicity, url_filters, warc


#: Characters of text that a page has at least, if it isn't thin.
THIN = 1400


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows, per document."""
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and verdict of every document."""
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_join.join_near_duplicates(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows, and the items whose rarest words stand near each other in it."""
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "near_items")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, placed in sequences of 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count and score of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url. The pages whose number occurs in `labels` are the reviewed ones; of those a page is bad if it is
    thin, with fewer than THIN characters outside its tags."""
    pages, reviewed = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    thin = F.length(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "")) < THIN
    labels = pages.select("page_id", thin.cast("int").alias("bad")).join(reviewed, "page_id", "left_semi")  # html stays where it is
    return url_filters.judge_urls(pages.select("page_id", "url"), labels)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture derived from `pages`, its 304 records resolved."""
    found = warc.resolve_revisits(warc.captures(_table(spark, sf_dir, "pages")))
    names = ("etag", "cache-control", "date", "expires", "last-modified", "content-type", "content-length")
    headers = [F.col("headers").getItem(n).alias(n.replace("-", "_")) for n in names]
    return found.select("record_id", "canonical_url", "status", "outcome", "source_id", "digest", "length", *headers)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language of `documents`."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of two tokenizers over every document, with the corpus-wide counts of its id pairs."""
    return token_alignment.align_and_count(_table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_packing": op6_packing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_token_alignment": op12_token_alignment,
    "op13_document_fingerprints": op13_document_fingerprints,
}



def _url_filters_sql() -> str:
    """The template tree in SQL, level by level, written apart from the operator."""
    u = url_filters

    def apart(l, b, l0, b0):
        p = f"(({b} + {b0}) / ({l} + {l0}))"
        return f"({l} > 0 and {l0} > 0 and power({b} / {l} - {b0} / {l0}, 2) > {u.CHI2} * {p} * (1 - {p}) * (1.0 / {l} + 1.0 / {l0}))"

    levels = "".join(f"""
    s{i} as (select host, template, segs[{i}] as seg, sum(n) as n, sum(l) as l, sum(b) as b from t{i - 1} where len(segs) >= {i} group by all),
    n{i} as (select host, template, sum(n) as n, sum(l) as l, sum(b) as b from s{i} group by all),
    k{i} as (select s.*, s.n >= {u.MIN_ROWS} and s.n >= {u.MIN_SHARE} * t.n as large from s{i} s join n{i} t using (host, template)
        where (s.n >= {u.MIN_ROWS} and s.n >= {u.MIN_SHARE} * t.n) or (s.l >= {u.LEAST_LABELS} and {apart('s.l', 's.b', '(t.l - s.l)', '(t.b - s.b)')})),
    o{i} as (select host, template, sum(n) as n, sum(l) as l, sum(b) as b from k{i} group by all),
    a{i} as (select host, template, seg, l, b, false as star from k{i} where large union all select host, template, '*', t.l - o.l, t.b - o.b, true from n{i} t join o{i} o using (host, template) where t.n > o.n),
    w{i} as (select *, case when l > 0 then b / l else -1 end as share from a{i}),
    x{i} as (select host, template, list([{{'l': l, 'b': b, 'star': star, 'segs': [seg]}}] order by share, star, seg) as kids from w{i} group by all),
    y{i} as (select host, template, unnest(list_reduce(kids, lambda g, x: case when (g[-1].l = 0) <> (x[1].l = 0) or {apart('g[-1].l', 'g[-1].b', 'x[1].l', 'x[1].b')}
        then g || x else g[1:len(g) - 1] || [{{'l': g[-1].l + x[1].l, 'b': g[-1].b + x[1].b, 'star': g[-1].star or x[1].star, 'segs': g[-1].segs || x[1].segs}}] end)) as g from x{i}),
    g{i} as (select host, template, list_sort(g.segs) as segs from y{i} where not g.star),
    h{i} as (select host, template, unnest(segs) as seg, case when len(segs) = 1 then segs[1] else '{{' || array_to_string(segs, '|') || '}}' end as label from g{i} union all select host, template, seg, seg from k{i} where not large),
    t{i} as (select t.host, t.path, t.n, t.l, t.b, t.segs, case when len(t.segs) < {i} then t.template else t.template || '/' || coalesce(h.label, '*') end as template
        from t{i - 1} t left join h{i} h on h.host = t.host and h.template = t.template and h.seg = t.segs[{i}]),""" for i in range(1, u.DEPTH + 1))
    rules = sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))
    hits = [(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')", h + p, said) for said, h, p in rules]
    rule = "case " + " ".join(f"when {test} then '{name}'" for test, name, _ in hits) + " end"
    verdict = "case " + " ".join(f"when {test} then '{said}'" for test, _, said in hits)
    return f"""with r0 as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    r1 as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r0),
    known as (select page_id, cast(max(case when length(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) < {THIN} then 1 else 0 end) as int) as bad from pages where page_id in (select doc_id from labels) group by page_id),
    t0 as (select host, path, count(*) as n, count(bad) as l, coalesce(sum(bad), 0) as b, list_filter(string_split(path, '/'), lambda s: s <> '') as segs, '' as template from r1 left join known using (page_id) where host <> '' group by host, path),{levels}
    done as (select host, path, l, b, template || case when len(segs) > {u.DEPTH} then '/**' else '' end || case when path = '' or ends_with(path, '/') then '/' else '' end as template from t{u.DEPTH}),
    judged as (select host, template, (sum(b) + {u.A}) / (sum(l) + {u.A} + {u.B}) >= {u.REJECT} as rejected from done group by all)
    select page_id, host, path, {rule} as rule, {verdict} when rejected then 'block' else 'allow' end as verdict, template
    from r1 left join (select host, path, template from done) using (host, path) left join judged using (host, template)"""


#: DuckDB SQL by query (op10's without bands or hashes: all pairs with a common shingle); a query without is tested against a brute-force version in tests/llm.
ORACLES: dict[str, str] = {
    "op1_url_filters": _url_filters_sql(),
    "op5_warc_revisits": """
with base as (select page_id p, url, [md5(coalesce(html, '') || '#0'), md5(coalesce(html, '') || '#1'), md5(coalesce(html, '') || '#2')] ds, strlen(coalesce(html, '')) len from pages),
full_ as (select *, p * 100 + v * 900 ts, ds[v + 1] digest from (select *, unnest(range(0, p % 3 + 1)) v from base)),
again as (select *, case when w = 1 then p * 100 + 1950 when p % 11 = 0 then p * 100 - 50 else p * 100 + 50 + p % 3 * 1000 end t, ds[case when w = 0 then p % 2 else p % 3 end + 1] named from (select *, unnest([0, 1]) w from base)),
rec as (
  select p * 8 + v record_id, url, ts, 200 status, digest, len, '"' || left(digest, 16) || '"' etag, 'max-age=60' cache_control,
    cast(ts as varchar) date, cast(null as varchar) expires, cast(ts - 7 as varchar) last_modified from full_
  union all
  select p * 8 + 4 + w, url || '#again', t, 304, null, null,
    case when p % 5 = 0 then null when p % 3 = 0 then 'W/"' || left(named, 16) || '"' else '"' || left(named, 16) || '"' end,
    case when p % 2 = 0 then 'max-age=120' end, cast(t as varchar), cast(t + 120 as varchar), case when p % 10 = 0 then cast(p * 100 - 7 as varchar) end
  from again),
parts as (select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) rest from rec),
named as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&') query
  from parts),
canon as (select *, case when host <> '' then host || path || case when query = '' then '' else '?' || query end end canonical_url from named),
joined as (
  select *, case when canonical_url is not null then last_value(case when status = 200 then {'record_id': record_id, 'digest': digest, 'len': len, 'etag': etag,
      'cache_control': cache_control, 'date': date, 'expires': expires, 'last_modified': last_modified} end ignore nulls)
    over (partition by canonical_url order by ts, record_id rows between unbounded preceding and 1 preceding) end source from canon),
judged as (
  select *, case when status = 200 then 'response' when source is null then 'missing'
    when etag is not null then case when regexp_replace(etag, '^W/', '') = regexp_replace(source.etag, '^W/', '') then 'resolved' else 'mismatch' end
    when last_modified is not null and source.last_modified is not null then case when last_modified = source.last_modified then 'resolved' else 'mismatch' end
    else 'unchecked' end outcome from joined)
select record_id, canonical_url, status, outcome, case when status = 200 then record_id when outcome in ('resolved', 'unchecked') then source.record_id end source_id,
  case when outcome in ('resolved', 'unchecked') then source.digest else digest end digest, case when outcome in ('resolved', 'unchecked') then source.len else len end length,
  case when outcome in ('resolved', 'unchecked') then coalesce(etag, source.etag) else etag end etag,
  case when outcome in ('resolved', 'unchecked') then coalesce(cache_control, source.cache_control) else cache_control end cache_control,
  date, expires, case when outcome in ('resolved', 'unchecked') then coalesce(last_modified, source.last_modified) else last_modified end last_modified,
  case when status = 200 or outcome in ('resolved', 'unchecked') then 'text/html' end content_type,
  case when status = 200 then cast(len as varchar) when outcome in ('resolved', 'unchecked') then cast(source.len as varchar) else '0' end content_length
from judged
""",
    "op2_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
windows as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') as k from (select *, unnest(range(1, len(ws) - 18)) as s from w)),
repeats as (select doc_id, s from windows qualify row_number() over (partition by k order by doc_id, s) > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as i from repeats),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from words anti join gone using (doc_id, i) group by doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from w left join kept using (doc_id) left join removed using (doc_id)
""",
    "op7_benchmark_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where item_id is not null),
iw as (select distinct item, span, array_to_string(ws[s:s + span - 1], ' ') as k from (select *, unnest(range(1, len(ws) - span + 2)) as s from (select *, least(10, len(ws)) as span from b where len(ws) > 0))),
dw as (select doc_id, span, s, array_to_string(ws[s:s + span - 1], ' ') as k from (select *, unnest(range(1, len(ws) - span + 2)) as s from d, (select distinct span from iw) where len(ws) >= span)),
hits as (select doc_id, item, s, span from dw join iw using (span, k)),
counted as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(s, s + span)) as i from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id),
tokens as (select doc_id, unnest(ws) as term, generate_subscripts(ws, 1) as pos from d),
terms as (select distinct item, unnest(ws) as term from b),
rare as (select item, term from terms left join (select term, count(*) as df from tokens group by term) using (term) qualify row_number() over (partition by item order by coalesce(df, 0), term) <= 3),
near as (select distinct doc_id, item from (select doc_id, item, need, count(distinct term) over (partition by doc_id, item order by pos range between 19 preceding and current row) as got
    from tokens join (select *, count(*) over (partition by item) as need from rare) using (term)) where got = need),
nears as (select doc_id, count(*) as n_near, string_agg(item, ',' order by item) as items from near group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items.items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near, sha256(coalesce(nears.items, '')) as near_sha256
from d left join counted using (doc_id) left join items using (doc_id) left join nears using (doc_id)
""",
    "op11_phrase_collocations": r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from d)),
g as (select lang, k, array_to_string(ws[s:s + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as s from p, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 30),
cuts as (select lang, c.phrase, c.k, a, cut, x.f as l, y.f as r, cast(2000000::hugeint * a // (x.f + y.f) as bigint) as score
  from (select *, unnest(range(1, k)) as cut, array_to_string(ws[1:cut], ' ') as first_part, array_to_string(ws[cut + 1:k], ' ') as rest from c) c
  join f x using (lang) join f y using (lang) where x.phrase = first_part and x.k = cut and y.phrase = rest and y.k = c.k - cut),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
around as (select lang, array_to_string(ws[s:s + m - 1], ' ') as phrase, max(a) as most from (select *, unnest(range(1, k - m + 2)) as s from (select *, unnest(range(2, k)) as m from c)) group by all),
kept as (select best.* from best left join around using (lang, phrase) where most is null or 100 * most < 80 * a)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join n using (lang) where rank <= 2000
""",
    "op10_ngram_jaccard_join": r"""
with recursive t as (select coalesce(text, '') as text, min(doc_id) as node, count(*) as copies from documents group by 1),
w as (select node, copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
sh as (select distinct node, array_to_string(ws[s:s + 4], ' ') as k from (select *, unnest(range(1, greatest(len(ws) - 3, 2))) as s from w where len(ws) > 0)),
n as (select node, count(*) as n from sh group by node),
c as (select a.node as u, b.node as v, count(*) as shared from sh a join sh b on a.k = b.k and a.node < b.node group by all),
linked as (select u, v from c join n a on a.node = u join n b on b.node = v where shared >= 0.8 * (a.n + b.n - shared) - 1e-9),
edges as (select u, v from linked union all select v, u from linked),
reach(node, root) as (select node, node from t union select edges.v, reach.root from reach join edges on edges.u = reach.node),
classes as (select node, min(root) as class_id from reach group by node),
links as (select u as node, sum(copies) as links, count(*) as texts from edges join t on t.node = v group by u)
select doc_id, class_id, cast(coalesce(links, 0) + copies - 1 as bigint) as n_links, coalesce(texts, 0) as n_text_links, copies as n_copies
from documents d join t on coalesce(d.text, '') = t.text join classes using (node) left join links using (node)
""",
}
