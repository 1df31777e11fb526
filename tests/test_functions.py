import pytest
from codeweave.functions import rules, scores, text
from pyspark.sql import functions as F


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("Repair of Knee-Arthroplasty, 3rd", ["repair", "knee", "arthroplasty", "3rd"]), ("Étude", ["tude"]), ("an MRI of ten", ["mri"]), ("", []), (None, []), ("knee knee", ["knee"])])
def test_tokens(spark, raw, want):
    assert col(spark, raw, text.tokens) == want


def test_tokens_of_the_second_list(spark):
    assert col(spark, "an MRI visit of ten", lambda c: text.tokens(c, text.STOP_CLASSIFY)) == ["mri", "ten"]


@pytest.mark.parametrize("raw,name,price", [("Visit ....... 42.50", "Visit", "42.50"), ("Visit $42.50", "Visit", "42.50"), ("fee 1,234.50", "fee 1,", "234.50"), ("No price", "No price", None), ("", "", None)])
def test_prices(spark, raw, name, price):
    assert (col(spark, raw, text.without_price), col(spark, raw, text.price_at_end)) == (name, price)


def test_clean(spark):
    assert col(spark, " a–b—c ‘d’ e®•�\t f ", text.clean) == "a-b-c 'd' e f"
    assert col(spark, "Québec’s•", text.norm) == "Quebec's•"


@pytest.mark.parametrize("code,province,want", [("A001B", "ON", ("A001", "B")), ("A0012C", "ON", ("A001", "2")), ("K040", "ON", ("K040", "A")), ("00158", "BC", ("158", "")), ("00", "BC", ("00", "")), ("000158", "BC", ("0158", "")), ("0615", "YT", ("0615", ""))])
def test_decoded_codes(spark, code, province, want):
    assert tuple(col(spark, code, lambda c: text.decoded_code(c, F.lit(province)))) == want


def test_scores(spark):
    a, b = F.array(*map(F.lit, ["knee", "arthroplasty", "revision"])), F.array(*map(F.lit, ["arthroplasty", "knee"]))
    none = F.array().cast("array<string>")
    row = spark.range(1).select(scores.token_score(a, b), scores.token_score(b, a), scores.token_score(a, b, scores.CLASSIFY), scores.token_score(b, a, scores.CLASSIFY), scores.token_score(a, none)).first()
    assert [round(x, 6) for x in row] == [0.666667, 0.866667, 0.666667, 0.883333, 0.0]


@pytest.mark.parametrize("score,label", [(0.55, "high"), (0.5499, "medium"), (0.30, "medium"), (0.15, "low"), (0.10, "very_low")])
def test_confidence(spark, score, label):
    assert spark.range(1).select(scores.confidence(F.lit(score))).first()[0] == label


@pytest.mark.parametrize("raw,category", [("general assessment and consultation", "002.000"), ("manuscript", "049.000"), ("add-on tonsillectomy", "046.000"), ("Surgical ASSIST", "073.000"), ("plain", None), ("hip\nreplac", None)])
def test_keyword_rules(spark, raw, category):
    at = col(spark, raw, lambda c: rules.first_rule(c, rules.KEYWORD_RULES))
    assert (rules.KEYWORD_RULES[at - 1][1] if at else None) == category


def test_rule_tables():
    assert len(rules.KEYWORD_RULES) == 55 and len(rules.SECTION_RULES) == 26 and len(rules.ON_CHAPTERS) == 29 and len(rules.BC_CHAPTERS) == 21 and len(rules.CHAPTER_NAMES) == 9


def test_vectors(spark):
    v = F.array(*map(F.lit, [3.0, 4.0]))
    row = spark.range(1).select(scores.dot(v, v), scores.l2_normalised(v), scores.l2_normalised(F.array(F.lit(0.0)))).first()
    assert row[0] == 25 and row[1] == [0.6, 0.8] and row[2] == [0.0]


def test_hints(spark):
    assert col(spark, "K040 S2071 00158", text.code_hints) == 3
    assert col(spark, "x" * 30, lambda c: text.truncated(c, 24, "!")) == "x" * 24 + "!"


def test_literals_that_patterns_need():
    from codeweave.functions.rules import KEYWORD_RULES, required_literals

    assert required_literals(r"\bc.?section|obstetric") == {"section", "obstetric"} and required_literals(r"a|b?") is None
    assert required_literals(r"counsell?ing") == {"counsel"} and required_literals(r"(?:ab|cde)+x") in ({"ab", "cde"}, {"x"}) and required_literals(r".*") is None
    assert all(required_literals(p) for p, *_ in KEYWORD_RULES)


def test_rules_by_literals_against_all_patterns(spark):
    """Texts around each pattern, in odd cases, with letters that fold to plain ones: the first pattern found is the same, few are run."""
    import random
    import re

    from codeweave.functions import rules
    from pyspark.sql import functions as F

    r = random.Random(3)
    words = sorted({w for p, *_ in rules.KEYWORD_RULES for w in re.findall(r"[a-z]{3,}", p)}) + ["of", "the", "\u017f", "\u212a", "\u0130", "\u0131", "\n", "ß"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(400)]
    texts += [t.upper() for t in texts[:100]] + [t.replace("s", "\u017f").replace("k", "\u212a") for t in texts[100:200]] + [t.replace("i", "\u0130") for t in texts[200:250]] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    plain = rules.first_hit([(F.col("x").rlike(f"(?iud){p}"), F.lit(i)) for i, (p, *_) in enumerate(rules.KEYWORD_RULES, 1)], F.lit(None).cast("int"))
    rows = df.select(rules.first_rule(F.col("x"), rules.KEYWORD_RULES).alias("got"), plain.alias("want"), rules.patterns_run(F.col("x"), rules.KEYWORD_RULES).alias("n")).collect()
    assert all(x.got == x.want for x in rows) and sum(x.got is not None for x in rows) > 100
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert docs.agg(F.avg(rules.patterns_run(F.col("text"), rules.KEYWORD_RULES))).first()[0] < 5


def test_blanks_and_letters_as_before(spark):
    """The quicker patterns hit what the plain ones do, on every kind of blank and letter; the blanks' one begins with what rules printable ASCII out."""
    import re

    from codeweave.functions import text as t

    parts = ["a", "B", "Ä", "ß", "\U0001d400", "中", "7", ".", " ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", "​", "12.50", "!", "~", "\x7f"]
    import random

    r = random.Random(1)
    rows = [("".join(r.choices(parts, k=r.randint(0, 12))),) for _ in range(400)]
    df = spark.createDataFrame(rows, "s string")
    plain = F.regexp_replace("s", f"^{t.SPACE}+|{t.SPACE}+$", "")
    ratio = F.regexp_count("s", F.lit(r"\p{Lu}")) / F.nullif(F.regexp_count("s", F.lit(r"\p{L}")), F.lit(0))
    price = t.nonblank(F.regexp_extract("s", rf"\$?(\d{{1,6}}\.\d{{2}}){t.SPACE}*$", 1))
    same = t.strip(F.col("s")).eqNullSafe(plain) & t.upper_ratio(F.col("s")).eqNullSafe(ratio) & t.price_at_end(F.col("s")).eqNullSafe(price)
    assert df.filter(~same).count() == 0
    assert re.match(r"\[\[\^!-~\]&&", t.BLANK)


def test_runs_of_blanks_are_squeezed(spark):
    """Runs of plain and other blanks in any order become one blank; a single plain blank is no match of the pattern."""
    import random

    r = random.Random(2)
    raw = ["".join(r.choice(["a", "b", " ", " ", "\t", " ", "\x1c", " ", "–"]) for _ in range(r.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in raw], "x string").select("x", text.clean(F.col("x")).alias("y"), text.norm(F.col("x")).alias("z"))
    assert all(row.y == row.z == " ".join(row.x.replace("–", "-").split()) for row in df.collect())
    plan = spark.range(1).select(text.clean(F.concat(F.lit("a b "), "id"))).where("true")._jdf.queryExecution().analyzed().toString()
    assert "(?<! )" in plan
