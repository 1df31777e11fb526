"""Benchmark decontamination over a positional inverted index of the training texts, in DataFrame operations only.

1. Item texts become windows of `length` words (an item of fewer words is one window).
2. The index: a stored table of postings (term, key, pos) of every term that an item has, over all documents; a row's key is a
   64-bit hash of doc_id and text. Other terms can't stand in a match, so they are left out: it answers these items,
   not later ones. Each row also leaves one entry without a term, at its number of words. Texts are split here, once.
3. The index's counts rank terms by rarity; each window keeps its two rarest terms, each item its NEAR_TERMS rarest.
4. Phrases. Postings meet the items' positions by term; pos - item position is a diagonal. A diagonal on which both rare
   terms of some window stand is a candidate: the intersection of offset-adjusted lists, from the rarest terms on.
   Candidates meet the other postings of their stretch of the document, and a window is matched if all its words stand on the
   diagonal, so matches are exact and texts are not read again.
5. Proximity. An item is near in a document if its rarest terms stand within NEAR_WORDS words: at each posting the last
   positions of the others are known from a running maximum.

The items' side is broadcast only if it is counted to be small (MAX_ITEM_ROWS); otherwise the same joins shuffle. A
passage that a third of all documents hold gives one candidate for each document and item, never pairs of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise

LENGTH = 10
NEAR_TERMS, NEAR_WORDS = 3, 20
#: Words of a stretch in which candidates meet postings.
STRETCH = 64
#: Rows of the items' windows, terms or positions that may be broadcast: some tens of MB at most.
MAX_ITEM_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but for digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; none for null.

    lower() alone would change other letters, so it serves only texts that are ASCII throughout.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def item_windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """item_id, item_words, variant (a hash of them, as an item may have several texts), span (words of a window), start (of each window in the item)."""
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item_words")).filter("item_id is not null and size(item_words) > 0").distinct()
    texts = texts.withColumn("span", F.least(F.lit(length), F.size("item_words"))).withColumn("variant", F.xxhash64("item_words"))
    return texts.select("*", F.explode(F.expr("sequence(0, size(item_words) - span)")).alias("start"))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def index_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc_id, key, pos) of the given terms (one column, term) in docs (doc_id, text), pos from 0; and for each row one of a null term at its number of words."""
    tokens = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(None).cast("string")))).alias("pos", "term"))
    marker = docs.sparkSession.range(1).select(F.lit(None).cast("string"))
    wanted = bounded_broadcast(terms.select(F.col("term").alias("_term")).distinct().union(marker), MAX_ITEM_ROWS)
    return tokens.join(wanted, F.col("term").eqNullSafe(F.col("_term")), "left_semi")


def build_index(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, counts): stored postings (term, doc_id, key, pos) of the items' terms, with each row's number of words, and occurrences (term, df) of those that occur."""
    terms = items.filter("item_id is not null").select(F.explode(words(F.col("text"))).alias("term"))
    index = materialise(index_terms(docs, terms), "decontamination-index")
    return index, materialise(index.filter("term is not null and doc_id is not null").groupBy("term").agg(F.count("*").alias("df")), "decontamination-counts")


def rare_positions(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window's two rarest positions p1, p2 (the same one for a window of one word); windows with an unseen word are gone."""
    at = windows.select("item_id", "item_words", "variant", "span", "start", F.explode(F.expr("sequence(start, start + span - 1)")).alias("p"))
    at = at.withColumn("term", F.expr("element_at(item_words, p + 1)")).join(counts, "term", "left")
    best = at.groupBy("item_id", "item_words", "variant", "span", "start").agg(F.count("df").alias("seen"), F.sort_array(F.collect_list(F.struct("df", "term", "p"))).alias("ranked"))
    return best.filter("seen = span").selectExpr("item_id", "item_words", "variant", "span", "start", "ranked[0].p as p1", "ranked[least(span - 1, 1)].p as p2")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = LENGTH, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, item_id, starts, span) of the rows of docs, by their keys, that hold windows of items.

    starts: first words, in the document, of the occurrences of the item's windows of `span` words; one row a diagonal. index: what
    build_index gave for the same tables, if it is there already. Rows without a doc_id are matched with none.
    """
    postings, counts = index or build_index(_plain(docs), items)
    postings = postings.filter("term is not null and doc_id is not null")
    windows = materialise(item_windows(items, length), "decontamination-windows")
    rare = materialise(rare_positions(windows, counts), "decontamination-rare")
    keys = rare.select("item_id", "variant", F.explode(F.array("p1", "p2")).alias("p"), "item_words").selectExpr("item_id", "variant", "p", "element_at(item_words, p + 1) as term").distinct()
    wanted = rare.groupBy("item_id", "variant", F.size("item_words").alias("n"), "span").agg(F.collect_list(F.struct("p1", "p2")).alias("wanted"))
    diagonals = postings.join(bounded_broadcast(keys, MAX_ITEM_ROWS), "term").select("key", "item_id", "variant", (F.col("pos") - F.col("p")).alias("d"), "p")
    diagonals = diagonals.groupBy("key", "item_id", "variant", "d").agg(F.collect_set("p").alias("found"))
    candidates = diagonals.join(bounded_broadcast(wanted, MAX_ITEM_ROWS), ["item_id", "variant"]).filter("exists(wanted, w -> array_contains(found, w.p1) and array_contains(found, w.p2))")
    candidates = materialise(candidates.select("key", "item_id", "variant", "n", "span", "d"), "decontamination-candidates")
    stretch = lambda pos: F.floor(pos / STRETCH)
    here = candidates.withColumn("stretch", F.explode(F.sequence(stretch(F.greatest("d", F.lit(0))), stretch(F.col("d") + F.col("n") - 1))))
    there = postings.select("key", "term", "pos", stretch(F.col("pos")).alias("stretch"))
    at = there.join(here, ["key", "stretch"]).withColumn("p", F.col("pos") - F.col("d")).filter("p between 0 and n - 1")
    positions = windows.select("item_id", "variant", F.posexplode("item_words").alias("p", "term")).distinct()
    on_diagonal = at.join(bounded_broadcast(positions, MAX_ITEM_ROWS), ["item_id", "variant", "p", "term"]).groupBy("key", "item_id", "variant", "span", "d").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    starts = "transform(filter(ps, (p, i) -> coalesce(get(ps, i + span - 1) = p + span - 1, false)), p -> p + d)"
    return on_diagonal.selectExpr("key", "item_id", f"{starts} as starts", "span").filter("size(starts) > 0")


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = NEAR_TERMS, within: int = NEAR_WORDS, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, item_id, pos): the item's `terms` rarest distinct words (all, if fewer) stand within `within` words that end at pos.

    An item with a word that no document has is near in none if that word is among its rarest.
    """
    postings, counts = index or build_index(_plain(docs), items)
    postings = postings.filter("term is not null and doc_id is not null")
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.explode(F.array_distinct(words(F.col("text")))).alias("term")).filter("item_id is not null").distinct()
    own = own.join(counts, "term", "left")
    ranked = own.groupBy("item_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))), 1, terms).alias("rarest"))
    keys = materialise(ranked.select("item_id", F.size("rarest").alias("need"), F.posexplode("rarest.term").alias("k", "term")), "decontamination-near")
    hits = postings.join(bounded_broadcast(keys, MAX_ITEM_ROWS), "term").select("key", "item_id", "need", "k", "pos")
    # only documents that hold all of an item's terms go on
    whole = hits.groupBy("key", "item_id").agg(F.expr("bit_or(1 << k)").alias("seen"), F.max("need").alias("need")).filter("seen = (1 << need) - 1").select("key", "item_id")
    hits = hits.join(whole, ["key", "item_id"], "left_semi")
    last = [f"if({k} < need, max(if(k = {k}, pos, null)) over (partition by key, item_id order by pos), pos)" for k in range(terms)]
    near = hits.selectExpr("key", "item_id", "pos", f"array({', '.join(last)}) as last")
    return near.filter(f"forall(last, x -> coalesce(x > pos - {within}, false))").select("key", "item_id", "pos")


def decontaminate(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated, n_near, near_items, near_sha256.

    A word is hit if it lies in an occurrence of any item's window; near_items are those of proximity_matches, whether hit or not.
    Null and empty texts have no words, null and empty items no windows; items with a null item_id are left out. Each row with a
    null doc_id comes back with its words counted and none hit. Repeated rows give a row each, rows of one doc_id with different
    texts each by its own text. Other columns of either table are ignored.
    """
    docs = _plain(docs)
    index = build_index(docs, items)
    found = phrase_matches(docs, items, length, index)
    spans = "array_distinct(flatten(transform(flatten(hits), h -> sequence(h.s, h.s + h.span - 1))))"
    hits = found.withColumn("hit", F.expr("transform(starts, s -> struct(s, span))"))
    hits = hits.groupBy("key").agg(F.collect_list("hit").alias("hits"), F.sort_array(F.collect_set("item_id")).alias("items"))
    hits = hits.select("key", F.size(F.expr(spans)).cast("long").alias("n_hit"), "items")
    near = proximity_matches(docs, items, index=index).groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("near_items"))
    none = F.array().cast("array<string>")
    rows = index[0].filter("term is null").select("doc_id", "key", F.col("pos").cast("long").alias("n_words"))
    both = rows.join(hits, "key", "left").join(near, "key", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "near_items": F.coalesce("near_items", none)})
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return both.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"), "near_items", digest("near_items").alias("near_sha256"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs, all columns, that hold no window of any item; rows without a doc_id stay."""
    hit = phrase_matches(docs, items, length).select(F.col("key").alias("_hit")).distinct()
    return docs.join(hit, row_key(docs["doc_id"], docs["text"]) == hit["_hit"], "left_anti")
