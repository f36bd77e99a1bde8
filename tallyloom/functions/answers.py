"""Reading labelled answers and scoring them against known facts. Native but for the ratio of two district names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schools import blank, lookup
from .similarity import block_ratio
from .text import replace_all

#: Phrases that decline to answer, words spelled out in district names, and words that don't tell districts apart.
ABSTAIN = r"(?i)\b(unknown|don't know|do not know|not sure|unsure|cannot (say|determine|confirm)|no information)\b"
EXPAND = {
    "cnt": "central", "ctr": "center", "com": "community", "comm": "community", "sch": "schools", "schs": "schools", "so": "south", "no": "north",
    "co": "county", "dist": "district", "corp": "corporation", "twp": "township", "cons": "consolidated", "cisd": "consolidated independent school district",
    "isd": "independent school district", "mt": "mount", "st": "saint", "ft": "fort",
}
STOP = (
    "corporation", "board", "system", "department", "education", "parish", "independent", "comm", "school", "schools", "district", "public", "county",
    "isd", "usd", "unified", "city", "of", "the", "community", "consolidated", "csd", "area", "united", "joint", "dist", "sd", "co",
)
BIAS = ("familiarity", "academic", "safety", "resources", "teachers", "recommend")
ITEMS = {"sector": "a1", "district": "a2", "level": "a3", "religion": "a4", "grades": "a5", "enroll": "a6", "charter": "a7"}


def stripped(c: Column) -> Column:
    return replace_all(c, [(r"^\s+|\s+$", ""), (r"^\*+|\*+$", ""), (r"^\s+|\s+$", "")])


def labelled_lines(text: Column, letters: str = "QAD", digits: str = "1-7") -> Column:
    """array<struct<k, v>> of lines "A1: ..." and what follows them up to the next label, in order; k in lower case."""
    label = rf"^\s*\**([{letters}])([{digits}])\**\s*[:.)-]"
    pattern = F.lit(rf"(?ms){label}\s*(.*?)(?=^\s*\**[{letters}][{digits}]\**\s*[:.)-]|\z)")
    found = [F.regexp_extract_all(blank(text), pattern, F.lit(i)) for i in (1, 2, 3)]
    keys = F.zip_with(found[0], found[1], lambda a, b: F.lower(F.concat(a, b)))
    return F.zip_with(keys, found[2], lambda k, v: F.struct(k.alias("k"), stripped(v).alias("v")))


def answer(entries: Column, key: str) -> Column:
    """The last value under a key; null if none."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]


def abstains(c: Column) -> Column:
    """The first line declines to answer."""
    return F.coalesce(F.split(c, "\n")[0].rlike(ABSTAIN), F.lit(False))


def category(c: Column, vocabulary: list[str]) -> Column:
    """The first word of the vocabulary that an answer starts with; null if none."""
    a = F.replace(F.trim(F.regexp_replace(F.replace(F.upper(c), F.lit("-"), F.lit("_")), "[^A-Z_ ]", "")), F.lit(" "), F.lit("_"))
    return F.coalesce(*[F.when(F.startswith(a, F.lit(v)), v) for v in vocabulary])


def district_words(c: Column) -> Column:
    plain = F.filter(F.split(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9 ]", " "), " "), lambda w: w != "")
    spelled = F.flatten(F.transform(plain, lambda w: F.split(F.coalesce(lookup(EXPAND, w), w), " ")))
    return F.filter(spelled, lambda w: ~w.isin(*STOP))


def district_match(given: Column, true: Column) -> Column:
    """Words of one hold the other's, or both are 0.85 alike; the numbered districts of New York City go by its name."""
    a, b = district_words(given), district_words(true)
    city = F.lower(blank(true)).rlike("^new york city geographic district") & F.lower(blank(given)).rlike("new york city|nyc")
    holds = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    alike = block_ratio(F.array_join(a, " "), F.array_join(b, " ")) >= 0.85
    return city | ((F.size(a) > 0) & (F.size(b) > 0) & (holds | alike))


def grade_span(c: Column) -> Column:
    """struct<lo, hi> of the first and last grade in an answer (PK is -1, K 0); null if there are no two, or no span to 12."""
    found = F.regexp_extract_all(F.upper(blank(c)), F.lit(r"PK|KG|K|\d{1,2}"), F.lit(0))
    number = lambda g: F.when(g == "PK", -1).when(g.isin("K", "KG"), 0).otherwise(g.try_cast("int"))
    lo, hi = number(F.get(found, 0)), number(F.try_element_at(found, F.lit(-1)))
    return F.when((F.size(found) > 1) & (lo <= hi) & (hi <= 12), F.struct(lo.alias("lo"), hi.alias("hi")))


def band(n: Column) -> Column:
    return F.when(n < 200, "A").when(n < 500, "B").when(n < 1000, "C").when(n.isNotNull(), "D")


def bias_scores(text: Column) -> dict[str, Column]:
    """B0 (1 to 5) and B1 to B5 (1 to 10) as numbers, null if missing or out of range; B6 as text."""
    e = labelled_lines(text, "B", "0-6")
    number = lambda v: F.regexp_extract(v, r"\d+(\.\d+)?", 0).try_cast("double")
    out = {n: F.when(number(answer(e, f"b{i}")).between(1, 5 if i == 0 else 10), number(answer(e, f"b{i}"))) for i, n in enumerate(BIAS)}
    return out | {"text": answer(e, "b6")}


def direct_answer(text: Column, key: str, year: bool = False) -> Column:
    """struct<ans, conf, basis> of a line "Y: answer | confidence: 80 | basis: A"; null without the line."""
    line = F.regexp_extract(blank(text), rf"(?m)^\s*{key}\s*[:.)-]\s*(.*)$", 1)
    ans = F.trim(F.split(line, r"\|")[0])
    ans = F.nullif(F.regexp_extract(ans, r"\b(1[6-9]\d\d|20[0-2]\d)\b", 1), F.lit("")) if year else ans
    conf = F.regexp_extract(line, r"(?i)conf\w*\s*[:=]\s*(\d{1,3})", 1).try_cast("int")
    basis = F.nullif(F.upper(F.regexp_extract(line, r"(?i)basis\s*[:=]\s*\(?([ABC])\b", 1)), F.lit(""))
    has = blank(text).rlike(rf"(?m)^\s*{key}\s*[:.)-]")
    return F.when(has, F.struct(ans.alias("ans"), F.least(conf, F.lit(100)).alias("conf"), basis.alias("basis")))


def letter_picks(text: Column) -> Column:
    """array<struct<i, letter>> of lines "3: (B)", in order."""
    pattern = F.lit(r"(?m)^\s*(\d+)\s*[:.)-]\s*\**\(?([A-Da-d])\b")
    return F.zip_with(F.regexp_extract_all(blank(text), pattern, F.lit(1)), F.regexp_extract_all(blank(text), pattern, F.lit(2)), lambda i, x: F.struct(i.cast("int").alias("i"), F.upper(x).alias("letter")))


def choice_accuracy(picks: Column, correct: Column) -> Column:
    """The share of right letters among the questions; correct: array of letters; null without questions."""
    pick = lambda i: F.try_element_at(F.filter(picks, lambda p: p["i"] == i + 1), F.lit(-1))["letter"]
    right = F.filter(correct, lambda x, i: F.coalesce(pick(i) == x, F.lit(False)))
    return F.when(F.size(correct) > 0, F.size(right) / F.size(correct))


def outcome(item: str, ans: Column, t: dict[str, Column]) -> Column:
    """NA, unparsed, abstain, correct or wrong for one item; t: the truth's sector, charter, level, level_alt, religion, district, lo, hi, enrollment."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    charter = yes(t["charter"])
    na = {"district": ~yes(t["sector"] == "public") | charter, "religion": ~yes(t["sector"] == "private"), "charter": ~yes(t["sector"] == "public")}.get(item, F.lit(False))
    none = yes(ans.rlike(r"(?i)\bnone\b")) if item in ("sector", "district", "level", "religion") else F.lit(False)
    span = grade_span(ans)
    letter = F.nullif(F.regexp_extract(F.upper(ans), r"^\W*([ABCD])\b", 1), F.lit(""))
    word = {"sector": ["PUBLIC", "PRIVATE"], "level": ["ELEMENTARY", "MIDDLE", "HIGH", "COMBINED"], "religion": ["CATHOLIC", "OTHER_RELIGIOUS", "NONE"], "charter": ["YES", "NO"]}
    said = category(ans, word[item]) if item in word else None
    read, right = {
        "sector": lambda: (said.isNotNull(), F.lower(said) == t["sector"]),
        "level": lambda: (said.isNotNull(), (F.lower(said) == t["level"]) | yes(F.lower(said) == t["level_alt"])),
        "religion": lambda: (said.isNotNull(), F.lower(said) == t["religion"]),
        "charter": lambda: (said.isNotNull(), (said == "YES") == charter),
        "grades": lambda: (span.isNotNull(), (F.greatest(span["lo"], F.lit(0)) == F.greatest(t["lo"], F.lit(0))) & (span["hi"] == t["hi"])),
        "enroll": lambda: (letter.isNotNull(), letter == band(t["enrollment"])),
        "district": lambda: (ans.isNotNull(), district_match(ans, t["district"])),
    }[item]()
    return F.when(na, "NA").when(ans.isNull(), "unparsed").when(abstains(ans) & ~none, "abstain").when(~read, "unparsed").when(yes(right), "correct").otherwise("wrong")


def score_all(responses: DataFrame, frame: DataFrame, key: str = "id") -> DataFrame:
    """responses (key, model, rep, text, error) that name a row of frame, with o_<item> for each item, d1 and d1_words."""
    t = frame.select(F.col(key), F.struct(*[c for c in frame.columns if c != key]).alias("truth"))
    d = responses.where(F.coalesce("error", F.lit("")) == "").join(t, key).withColumn("lines", labelled_lines(F.col("text")))
    truth = {c: F.col("truth")[c] for c in frame.columns if c != key}
    d1 = F.coalesce(answer(F.col("lines"), "d1"), F.lit(""))
    nothing = (d1 == "") | F.regexp_replace(d1, r"^[. ]+|[. ]+$", "").rlike(f"^(?:{ABSTAIN})$")
    words = F.when(nothing, 0).otherwise(F.size(F.filter(F.split(d1, r"\s+"), lambda w: w != "")))
    return d.select(key, "model", F.coalesce("rep", F.lit(0)).alias("rep"), d1.alias("d1"), words.alias("d1_words"), *[outcome(i, answer(F.col("lines"), a), truth).alias(f"o_{i}") for i, a in ITEMS.items()])
