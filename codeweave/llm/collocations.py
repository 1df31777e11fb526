"""Phrase collocations by weighted acyclic automata (see transducers), language by language.

Texts are cut at punctuation and line ends into pieces, pieces into words. Labels are 64-bit hashes of (language, word).

1. Words are counted by a plain aggregation; the frequent ones keep their text.
2. Each task counts the n-grams of some millions of words, sorts them, and builds a count transducer for each prefix range; ranges
   are dealt by a hash of the first two words, their number by the language's size, so no range grows with the corpus.
   Transducers of one range meet in a group, which unites them and drops what is rare.
3. First pairs of words are counted, then three and four words together. A part of a frequent phrase is frequent, so a pass skips
   n-grams with a part that isn't in a Bloom filter of the last one: at most FILTER_BITS, whatever the corpus. False hits cost
   time only.
4. Part lookups: each range sends every range that holds parts of its phrases an automaton of them, weighted with the greatest
   count of a longer phrase around each. There it is composed with the counts; the composition goes back, and the weights say
   which phrases a longer one covers. A part travels once for each range, however many phrases share it.
5. The best of each language get their texts from the table of words and are ranked.

Counts are exact up to collisions of 64-bit labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, _is_word_table, byte_hashes, materialise, mix, text_buffers, words_of
from .transducers import CountTransducer, combine, sort_rows

LONGEST, LEAST, SCALE, COVERED, TOP = 4, 30, 2_000_000, 80, 2000
#: Words of a language for each of its ranges, and words of a task whose n-grams are counted together.
RANGE_WORDS, RUN_WORDS = 1_500_000, 1_000_000
#: Bits of a filter for each of its phrases, at least and at most of all, and in a segment.
PHRASE_BITS, LEAST_BITS, FILTER_BITS, SEGMENT_BITS = 16, 1 << 20, 1 << 28, 1 << 20
UNKNOWN = "und"
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
TOKENS = _is_word_table(_BREAKS + b"\x09\x20")
_IS_BREAK = ~_is_word_table(_BREAKS)
_FST = "lang string, part int, fst binary, n long"


def words(text: Column) -> Column:
    """All words of all pieces, A-Z lower-cased."""
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(folded, r"[\x09-\x0D\x20.,;:!?]+"), "")


def _hashes(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    return byte_hashes(data, offsets[:-1], offsets[1:]) if len(column) else np.zeros(0, U64)


def _labels(word_hashes: np.ndarray, lang_hashes: np.ndarray) -> np.ndarray:
    return np.maximum(mix(word_hashes + mix(lang_hashes ^ U64(0xA24BAED4963EE407))), U64(1))


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9FB21C651E98DF25) + mix(b))


def _phrase_keys(rows: np.ndarray) -> np.ndarray:
    """A key of each phrase of a word or two."""
    second = rows[:, 1] if rows.shape[1] > 1 else np.zeros(len(rows), U64)
    return np.where(second == 0, mix(rows[:, 0]), _pair_keys(rows[:, 0], second))


def _parts_of(rows: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    """The range of each phrase among `parts`, by its first two words."""
    return ((_phrase_keys(rows[:, :2]) >> U64(20)) % np.asarray(parts).astype(U64)).astype(np.int64)


class Filter:
    """A Bloom filter of phrase keys in segments, two bits a key."""

    def __init__(self, segments: np.ndarray):
        self.bits = segments.reshape(-1)
        self.segments = len(segments)

    @staticmethod
    def places(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = U64(SEGMENT_BITS - 1)
        return (keys >> U64(42)) % U64(segments), keys & low, (keys >> U64(21)) & low

    def has(self, keys: np.ndarray) -> np.ndarray:
        segment, a, b = self.places(keys, self.segments)
        out = np.ones(len(keys), dtype=bool)
        for bit in (a, b):
            at = segment * U64(SEGMENT_BITS) + bit
            out &= (self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        return out


def _filter(spark, counted: DataFrame):
    """A broadcast Filter of all phrases of `counted`."""
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    segments = min(FILTER_BITS, max(LEAST_BITS, 1 << int(n * PHRASE_BITS).bit_length())) // SEGMENT_BITS

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fst in batch.column("fst"):
                k = _phrase_keys(CountTransducer.from_bytes(fst.as_py()).paths()[0])
                segment = Filter.places(k, segments)[0]
                order = np.argsort(segment, kind="stable")
                cuts = np.searchsorted(segment[order], np.arange(segments + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([k[order[cuts[s] : cuts[s + 1]]].tobytes() for s in some], pa.binary())], names=["segment", "keys"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SEGMENT_BITS // 8, dtype=np.uint8)
        for part in rows["keys"]:
            _, *places = Filter.places(np.frombuffer(part, dtype=U64), segments)
            for at in places:
                np.bitwise_or.at(bits, (at >> U64(3)).astype(np.int64), U64(1).astype(np.uint8) << (at & U64(7)).astype(np.uint8))
        return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "bits": [bits.tobytes()]})

    filled = counted.select("fst").mapInArrow(keys, "segment int, keys binary").groupBy("segment").applyInPandas(fill, "segment int, bits binary")
    whole = np.zeros((segments, SEGMENT_BITS // 8), dtype=np.uint8)
    for r in filled.toLocalIterator():  # FILTER_BITS at most
        whole[r["segment"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(Filter(whole))


def _grams(labels: np.ndarray, joined: np.ndarray, low: int, high: int, known: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of low to high words as rows of `high` labels, place of each) whose parts `known` has."""
    if low == 2:
        had = known.has(mix(labels))
        pairs = joined[:-1] & had[:-1] & had[1:]
    else:
        pairs = joined[:-1].copy()
        at = np.flatnonzero(pairs)
        pairs[at] = known.has(_pair_keys(labels[at], labels[at + 1]))
    rows, places = [], []
    for size in range(low, high + 1):
        good = np.ones(max(0, len(labels) - size + 1), dtype=bool)
        for d in range(size - 1):
            good &= pairs[d : d + len(good)]
        at = np.flatnonzero(good)
        rows.append(np.stack([labels[at + d] if d < size else np.zeros(len(at), U64) for d in range(high)], axis=1))
        places.append(at)
    return np.concatenate(rows), np.concatenate(places)


def _shard_batches(shared, ranges: dict[str, int], low: int, high: int):
    """Runs of some millions of words to a count transducer of their n-grams for each language and range."""

    def flush(langs: list[str], labels: list, joined: list, owner: list) -> Iterator[pa.RecordBatch]:
        labels, joined, owner = (np.concatenate(x) for x in (labels, joined, owner))
        rows, at = _grams(labels, joined, low, high, shared.value)
        lang = owner[at]
        parts = np.array([ranges.get(x, 1) for x in langs])
        group = lang * (int(parts.max()) + 1) + _parts_of(rows, parts[lang])
        rows, counts, group = combine(rows, np.ones(len(rows), np.int64), group=group)
        bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            of, part = divmod(int(group[a]), int(parts.max()) + 1)
            out.append((langs[of], part, CountTransducer.build(rows[a:b], counts[a:b]).to_bytes(), b - a))
        yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held: list[list] = [[], [], []]
        n = 0
        for batch in batches:
            lang = batch.column("lang")
            seeds, code = _hashes(lang), np.array([codes.setdefault(x, len(codes)) for x in lang.to_pylist()], dtype=np.int64)
            for first, _, w in words_of(batch.column("text"), TOKENS, LOWER):
                if not len(w.starts):
                    continue
                piece = np.cumsum(_IS_BREAK[w.data])[w.starts]
                joined = np.append((piece[1:] == piece[:-1]) & (w.text[1:] == w.text[:-1]), False)
                for part, values in zip(held, (_labels(w.hashes, seeds[first + w.text]), joined, code[first + w.text]), strict=True):
                    part.append(values)
                n += len(joined)
                if n >= RUN_WORDS:
                    yield from flush(list(codes), *held)
                    held, n = [[], [], []], 0
        if n:
            yield from flush(list(codes), *held)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    lang, part, fst, n = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.int32()), pa.array(fst, pa.binary()), pa.array(n, pa.int64())], names=["lang", "part", "fst", "n"])


def _united(least: int):
    """The transducers of one range as one, with the phrases of `least` at least."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one = CountTransducer.union([CountTransducer.from_bytes(x) for x in rows["fst"]], least=least)
        n = int((one.weight > 0).sum())
        many = pd.DataFrame({"lang": [rows["lang"].iloc[0]], "part": [rows["part"].iloc[0]], "fst": [one.to_bytes()], "n": [n]})
        return many if n else many.iloc[:0]

    return run


def _word_labels(ranges: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = _labels(_hashes(batch.column("word")), _hashes(batch.column("lang")))
            parts = np.array([ranges.get(x, 1) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            part = _parts_of(labels[:, None], parts) if len(labels) else parts
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "word", "n")), pa.array(labels.view(np.int64)), pa.array(part.astype(np.int32))], names=["lang", "word", "n", "label", "part"])

    return run


def _word_transducer(rows: pd.DataFrame) -> pd.DataFrame:
    labels, n = combine(rows["label"].to_numpy().view(U64)[:, None], rows["n"].to_numpy())
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "part": [rows["part"].iloc[0]], "fst": [CountTransducer.build(labels, n).to_bytes()], "n": [len(n)]})


def _sub_phrases(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct parts of phrases, greatest count of a phrase around each): runs of two words and more, and first and last words."""
    length, width = (rows != 0).sum(axis=1), rows.shape[1]
    parts, around = [np.zeros((0, width), U64)], [np.zeros(0, np.int64)]
    for size in range(2, width + 1):
        of = np.flatnonzero(length == size)
        cuts = [(start, n) for n in range(2, size) for start in range(size - n + 1)] + [(0, 1), (size - 1, 1)]
        for start, n in cuts:
            parts.append(np.pad(rows[of, start : start + n], ((0, 0), (0, width - n))))
            around.append(counts[of])
    return combine(np.concatenate(parts), np.concatenate(around), np.maximum)


def _ask_batches(ranges: dict[str, int]):
    """Each range's parts, as an automaton for each range that may hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part, fst in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist(), batch.column("fst"), strict=True):
                rows, around = _sub_phrases(*CountTransducer.from_bytes(fst.as_py()).paths())
                there = _parts_of(rows, ranges.get(lang, 1))
                out = [(lang, int(p), part, CountTransducer.build(rows[there == p], around[there == p]).to_bytes()) for p in np.unique(there)]
                names, types = ("lang", "part", "origin", "fst"), (pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))

    return run


def _answer(counts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """What each asking range gets back (kind 0: counts of its parts), and the counts around this range's phrases (kind 1)."""
    out = []
    if len(counts) and len(asked):
        own, around = CountTransducer.from_bytes(counts["fst"].iloc[0]), []
        lang, part = counts["lang"].iloc[0], counts["part"].iloc[0]
        for origin, fst in zip(asked["origin"], asked["fst"], strict=True):
            rows, weights, found = CountTransducer.from_bytes(fst).compose(own)
            order = sort_rows(rows)
            out.append((lang, origin, 0, CountTransducer.build(rows[order], found[order]).to_bytes()))
            longer = (rows != 0).sum(axis=1) > 1
            around.append(CountTransducer.build(rows[order][longer[order]], weights[order][longer[order]]))
        out.append((lang, part, 1, CountTransducer.union(around, np.maximum).to_bytes()))
    return pd.DataFrame(out, columns=["lang", "part", "kind", "fst"]).astype({"part": "int32", "kind": "int32"})


def exact_scores(a: np.ndarray, both: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * a / both) in whole numbers, also where the product passes 64 bits; a is at most half of both."""
    if not len(a) or int(a.max()) < (1 << 62) // scale:
        return a * scale // np.maximum(both, 1)
    return np.array([int(x) * scale // int(y) for x, y in zip(a, both, strict=True)], dtype=np.int64)


def _judge(covered: int, scale: int, top: int):
    """Scores of a range's phrases; those that aren't covered and may be among the best."""

    def run(counts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["lang", "words", "a", "l", "r", "score"]
        if not len(counts):
            return pd.DataFrame(columns=names)
        rows, a = CountTransducer.from_bytes(counts["fst"].iloc[0]).paths()
        size = (rows != 0).sum(axis=1)
        rows, a, size = rows[size > 1], a[size > 1], size[size > 1]
        found = {k: [CountTransducer.from_bytes(x) for x in answers["fst"][answers["kind"] == k]] for k in (0, 1)}
        known, around = CountTransducer.union(found[0], np.maximum), CountTransducer.union(found[1], np.maximum)
        best = [np.full(len(a), -1), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)]
        for cut in range(1, rows.shape[1]):
            at = np.flatnonzero(size > cut)
            left, right = rows[at, :cut], rows[at, cut:]
            l, r = known.counts_of(left), known.counts_of(right)
            score = exact_scores(a[at], l + r, scale)
            less = (best[0][at] < 0) | (score < best[0][at])
            for values, now in zip(best, (score, l, r), strict=True):
                values[at[less]] = now[less]
        keep = np.flatnonzero(100 * around.counts_of(rows) < covered * a)
        order = keep[np.lexsort((-a[keep], -best[0][keep]))]
        if len(order) > top:
            last = order[top - 1]
            order = order[(best[0][order] > best[0][last]) | ((best[0][order] == best[0][last]) & (a[order] >= a[last]))]
        phrases = [rows[i, : size[i]].view(np.int64) for i in order]
        return pd.DataFrame({"lang": counts["lang"].iloc[0], "words": pd.Series(phrases, dtype=object), "a": a[order], "l": best[1][order], "r": best[2][order], "score": best[0][order]}, columns=names)

    return run


def mine(docs: DataFrame, least: int = LEAST, covered: int = COVERED, scale: int = SCALE, top: int = TOP, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to four words.

    docs: text and lang; a null lang counts as `und`, a null text as empty. n: the language's words, a: the phrase's occurrences
    (overlaps included) within pieces, at least `least`. Of the cuts into a first part and a rest, with l and r occurrences, the one of the
    lowest score = floor(scale * a / (l + r)) counts, the first of equal ones. Phrases within a longer one that occurs
    `covered` hundredths as often or more are left out. Ranked by score, a, both descending, and phrase. Repeated rows count each; other
    columns are ignored; an empty table, or one without frequent phrases, gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = docs.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # rare words only count for their language's total
    kept = each.groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    kept = materialise(kept, "collocation-words")
    totals = kept.groupBy("lang").agg(F.sum("n").alias("n"))
    ranges = {r["lang"]: -(-r["n"] // range_words) for r in totals.filter(F.col("n") > range_words).collect()}  # a row for each language of some size
    vocabulary = materialise(kept.filter("word is not null").mapInArrow(_word_labels(ranges), "lang string, word string, n long, label long, part int"), "collocation-vocabulary")
    counted = [materialise(vocabulary.groupBy("lang", "part").applyInPandas(_word_transducer, _FST), "collocation-1")]
    for low, high in ((2, 2), (3, LONGEST)):
        shards = docs.mapInArrow(_shard_batches(_filter(spark, counted[-1]), ranges, low, high), _FST)
        counted.append(materialise(shards.groupBy("lang", "part").applyInPandas(_united(least), _FST), f"collocation-{high}"))
    counts = materialise(counted[0].union(counted[1]).union(counted[2]).groupBy("lang", "part").applyInPandas(_united(least), _FST), "collocation-counts")
    asked = counts.mapInArrow(_ask_batches(ranges), "lang string, part int, origin int, fst binary")
    grouped = counts.groupBy("lang", "part")
    answers = grouped.cogroup(asked.groupBy("lang", "part")).applyInPandas(_answer, "lang string, part int, kind int, fst binary")
    judged = grouped.cogroup(answers.groupBy("lang", "part")).applyInPandas(_judge(covered, scale, top), "lang string, words array<long>, a long, l long, r long, score long")
    by = Window.partitionBy("lang")
    best = judged.withColumn("place", F.rank().over(by.orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top).drop("place")
    best = materialise(best, "collocation-best")
    spelt = best.select("*", F.posexplode("words").alias("at", "label")).join(vocabulary.select("lang", "label", "word"), ["lang", "label"])
    spelt = spelt.groupBy("lang", "words", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = spelt.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
