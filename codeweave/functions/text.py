"""Text functions over columns: cleaning, price splitting, tokens, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the tokenizers of the rules see it, ASCII separators 1C-1F and all Unicode blanks included.
SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same for the JVM's patterns: printable ASCII fails the first test, not the last of a dozen.
BLANK = rf"[[^!-~]&&{SPACE}]"

#: Words that carry no meaning in fee names. The first list serves lookup and linking, the second classification.
STOP_BOTH = (
    "the a an and or of for to in on with by at from as is are be this that per each full quarter hour payment rules including only when not no any all if "
    "other than also where may used use within after before without during which who same more one two three four five"
).split()
STOP_LOOKUP = [*STOP_BOTH, "six", "seven", "eight", "nine", "ten"]
STOP_CLASSIFY = [*STOP_BOTH, "visit", "service", "services", "procedure", "procedures"]


def text_or_blank(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def nonblank(c: Column | str) -> Column:
    """The column where it isn't the empty string, else null."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}++$", "")


def _squeezed(c: Column) -> Column:
    # single plain blanks, nearly all of them, are no match, so they aren't replaced by themselves
    return F.btrim(F.regexp_replace(c, f"{BLANK}(?:(?<! ){BLANK}*+|{BLANK}++)", " "))  # runs are single blanks by then


def _translated(c: Column, old: str, new: str) -> Column:
    """translate(), which goes character by character, for texts that hold one of the characters."""
    return F.when(c.rlike(f"[{old}]"), F.translate(c, old, new)).otherwise(c)


def clean(c: Column) -> Column:
    """Plain dashes and quotes, no trademark signs or bullets, single blanks."""
    return _squeezed(_translated(c, "–—’‘\N{NO-BREAK SPACE}®\N{REPLACEMENT CHARACTER}•", "--'' "))


def norm(c: Column) -> Column:
    """As clean, for reference documents: an e with an acute loses it; opening quotes, trademark signs and bullets stay."""
    return _squeezed(_translated(c, "–—’é\N{NO-BREAK SPACE}\N{REPLACEMENT CHARACTER}", "--'e "))


def strip_leaders(c: Column) -> Column:
    """Runs of three dots or more become a blank; blanks, dots and dashes go from both ends."""
    return F.btrim(F.regexp_replace(c, r"\.{3,}", " "), F.lit(" .-"))


def price_at_end(c: Column) -> Column:
    """The amount with two decimals that ends the text, or null."""
    return nonblank(F.regexp_extract(c, rf"\$?(\d{{1,6}}\.\d{{2}}){BLANK}*$", 1))


def without_price(c: Column) -> Column:
    return strip_leaders(F.regexp_replace(c, rf"\$?\d{{1,6}}\.\d{{2}}{BLANK}*$", ""))


def tokens(c: Column, stop: list[str] = STOP_LOOKUP) -> Column:
    """Distinct lower-case words of a-z and 0-9 longer than two, stop words apart, in order of appearance."""
    words = F.regexp_extract_all(F.lower(text_or_blank(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*map(F.lit, stop))))


def letters(c: Column) -> Column:
    """The letters of a text; runs of other characters go at once."""
    return F.regexp_replace(c, r"\P{L}+", "")


def upper_share(letters: Column | str) -> Column:
    """Share of upper-case letters among letters (see letters()); null without letters."""
    return F.length(F.regexp_replace(letters, r"\P{Lu}+", "")) / F.nullif(F.length(letters), F.lit(0))


def upper_ratio(c: Column) -> Column:
    """Share of upper-case letters among the letters of a text; null without letters."""
    return upper_share(letters(c))


def joined_nonblank(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[nonblank(strip(text_or_blank(p))) for p in parts])


def record_text(fn: Column, description: Column, section: Column, subsection: Column, chapter: Column, label: Column, code: Column | None = None) -> Column:
    """What stands for a record in similarity: its non-blank parts; for embeddings, its code where all are blank."""
    text = joined_nonblank(" | ", fn, description, section, subsection, chapter, label)
    return text if code is None else F.coalesce(nonblank(text), code)


def truncated(c: Column, size: int, marker: str = "") -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit(marker))).otherwise(c)


def category_codes(c: Column) -> Column:
    """All categories ddd.ddd of a text."""
    return F.regexp_extract_all(text_or_blank(c), F.lit(r"\d{3}\.\d{3}"), F.lit(0))


def named_category_codes(c: Column) -> Column:
    """The categories that stand after the letters NGS."""
    return F.regexp_extract_all(text_or_blank(c), F.lit(rf"(?i)NGS{SPACE}+(\d{{3}}\.\d{{3}})"), F.lit(1))


#: What looks like a fee code in page text.
CODE_HINT = r"\b[A-Z]\d{4,}\b|\b\d{5}\b|\bV\d{5}\b|\b[A-Z]\d{3}\b"


def code_hints(c: Column) -> Column:
    return F.regexp_count(text_or_blank(c), F.lit(CODE_HINT))


def canonical_code(c: Column) -> Column:
    return F.upper(strip(text_or_blank(c)))


def decoded_code(code: Column, province: Column) -> Column:
    """struct(fee, role): ON splits off the fifth character (A if there is none), BC drops up to two leading zeros."""
    bare = F.regexp_replace(code, "^0{1,2}", "")
    return (
        F.when((province == "ON") & (F.length(code) >= 5), F.struct(F.substring(code, 1, 4).alias("fee"), F.substring(code, 5, 1).alias("role")))
        .when(province == "ON", F.struct(code.alias("fee"), F.lit("A").alias("role")))
        .when(province == "BC", F.struct(F.when(bare == "", code).otherwise(bare).alias("fee"), F.lit("").alias("role")))
        .otherwise(F.struct(code.alias("fee"), F.lit("").alias("role")))
    )
