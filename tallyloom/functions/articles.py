"""Short articles and fact sheets out of records: each clause is a column that is null where its fields are missing, and joining leaves it out.

Records are columns of text by the names of the public and private masters; everything is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import schools as H
from . import text as X

#: The school years of both sectors' data.
YEARS = {"public": "2024-25", "private": "2023-24"}
#: Words and phrases for codes.
PUBLIC_TYPES = {"Regular": "", "Other/Alternative": "alternative ", "Special Education": "special-education ", "Vocational": "vocational "}
PUBLIC_PLACES = {
    "City, Large": "a large city", "City, Midsize": "a midsize city", "City, Small": "a small city",
    "Suburban, Large": "a large suburb", "Suburban, Midsize": "a midsize suburb", "Suburban, Small": "a small suburb",
    "Town, Fringe": "a town on the urban fringe", "Town, Distant": "a distant town", "Town, Remote": "a remote town",
    "Rural, Fringe": "a rural area near a city", "Rural, Distant": "a distant rural area", "Rural, Remote": "a remote rural area",
}
PRIVATE_PLACES = {
    "11": "a large city", "12": "a midsize city", "13": "a small city", "21": "a large suburb", "22": "a midsize suburb", "23": "a small suburb",
    "31": "a town on the urban fringe", "32": "a distant town", "33": "a remote town", "41": "a rural area near a city", "42": "a distant rural area", "43": "a remote rural area",
}
PRIVATE_TYPES = {"1": "", "2": "Montessori ", "3": "special-program ", "4": "special-education ", "5": "career and technical ", "6": "alternative ", "7": "early-childhood "}
RELIGIONS = {"1": "Catholic", "2": "religiously affiliated", "3": "nonsectarian"}
SEXES = {"1": "coeducational", "2": "all-boys", "3": "all-girls"}
PRIVATE_LEVELS = {"1": "elementary ", "2": "secondary ", "3": ""}
RACES = {"White": "PSS_WHITE_PCT", "Black": "PSS_BLACK_PCT", "Hispanic": "PSS_HISP_PCT", "Asian": "PSS_ASIAN_PCT", "American Indian": "PSS_INDIAN_PCT", "Pacific Islander": "PSS_PACISL_PCT", "two or more races": "PSS_TWOMORE_PCT"}
GRADES = ("PK", "K", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12")
#: Words that title case leaves in capitals, and words that say that a name is a district's.
CAPITALS = ("US", "USA", "DC", "II", "III", "IV", "JR", "SR", "ISD", "USD", "SD", "CSD", "ESD", "RSD", "UFSD", "CUSD", "HS", "MS", "JSHS", "STEM", "STEAM", "NCEA", "YMCA", "MLK", "JFK", "ROTC", "AP", "IB")
DISTRICTS = ("district", "isd", "usd", "csd", "schools", "unified", "diocese", "archdiocese")
#: Abbreviations in names that are spelled out, and last words that "School" follows.
SPELLED = (
    (r"\bH\.? ?S\.?(?=\s|$)", "High School"), (r"\bM\.? ?S\.?(?=\s|$)", "Middle School"), (r"\bElem\.?(?=\s|$)", "Elementary"), (r"\bSr\.? High\b", "Senior High"),
    (r"\bJr\.? High\b", "Junior High"), (r"\bMid\.?(?=\s|$)", "Middle"), (r"\bSch\.?(?=\s|$)", "School"), (r"\bAcad\.?(?=\s|$)", "Academy"),
)
LAST_WORDS = r"\b(High|Middle|Elementary|Intermediate|Primary)$"


def field(r: dict[str, Column], name: str) -> Column:
    """A record's field without spaces around it; '' where it is null or not there."""
    return F.trim(F.coalesce(r[name].cast("string"), F.lit(""))) if name in r else F.lit("")


def whole(c: Column) -> Column:
    """A number rounded to whole, halves to even; null if it is none."""
    return F.bround(c.try_cast("double"), 0).cast("long")


def title_case(c: Column) -> Column:
    """Text in capitals alone with each word capitalised, but for CAPITALS; other text as it is."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    put = F.transform(words, lambda w: F.when(F.regexp_replace(w, "^[.,]+|[.,]+$", "").isin(*CAPITALS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))))
    return F.when((F.upper(c) == c) & (F.lower(c) != c), F.array_join(put, " ")).otherwise(c)


def display_name(c: Column) -> Column:
    """A school's name for prose: no capitals alone, abbreviations spelled out, "School" after a bare level."""
    name = F.coalesce(c, F.lit(""))
    lower = F.array_join(F.transform(F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    name = F.when((F.upper(name) == name) & (F.lower(name) != name), lower).otherwise(name)
    return F.trim(X.replace_all(name, [*SPELLED, (LAST_WORDS, "$1 School"), (r"\s+", " ")]))


def grade(c: Column) -> Column:
    """K for KG, no zeros in front; other codes as they are."""
    code = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(code.isin("KG", "K"), "K").when(code == "PK", "PK").otherwise(F.ltrim(code, F.lit("0")))


def level_word(lo: Column, hi: Column) -> Column:
    """"elementary ", "middle ", "high " by the grades; '' for other spans."""
    at = lambda c: H.lookup({g: str(i) for i, g in enumerate(GRADES)}, c).cast("int")
    a, b = at(lo), at(hi)
    n = {g: i for i, g in enumerate(GRADES)}
    return F.when(b <= n["5"], F.when(a.isNotNull(), "elementary ").otherwise("")).when((b <= n["8"]) & (a >= n["4"]), "middle ").when((b >= n["9"]) & (a >= n["7"]), "high ").otherwise("")


def district_name(c: Column) -> Column:
    """Without what legal names say about counties."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?is)\s+in the (county|city|borough|parish|town) of .*$", "")), ",+$", "")


def district_phrase(c: Column) -> Column:
    """"the Troy school district": the words that are missing put in; '' for none."""
    d = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(d)
    named = F.exists(F.array(*[F.lit(w) for w in DISTRICTS]), lambda w: F.contains(low, w))
    name = F.when(named, d).otherwise(F.concat(d, F.lit(" school district")))
    return F.when(d == "", "").when(F.startswith(low, F.lit("the ")), name).otherwise(F.concat(F.lit("the "), name))


def share(c: Column) -> Column:
    """A number of one decimal as text, without a zero at the end."""
    return F.regexp_replace(F.format_string("%.1f", c), r"\.0$", "")


def one_decimal(c: Column) -> Column:
    return F.bround(c.try_cast("double"), 1)


def listed(items: Column) -> Column:
    """a; a, and b; a, b, and c."""
    n = F.size(items)
    rest = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 1, F.get(items, 0)).when(n > 1, F.concat(rest, F.lit(", and "), F.element_at(items, -1)))


def place(city: Column, county: Column, state: Column) -> Column:
    parts = F.filter(F.array(city, county, state), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit(" in "), F.array_join(parts, ", "))).otherwise("")


def state_name(c: Column) -> Column:
    return F.coalesce(H.lookup(H.NAMES | H.PROSE_NAMES, c), c)


def grades_clause(lo: Column, hi: Column) -> Column:
    return F.when((lo != "") & (hi != ""), F.concat(F.lit(", serving grades "), lo, F.lit("–"), hi)).otherwise("")


def size_clause(r: dict[str, Column], year: str) -> Column:
    """Pupils, and teachers with the ratio where it is known; null without pupils."""
    pupils, teachers = whole(field(r, "total_students")), whole(field(r, "teachers"))
    stored = one_decimal(field(r, "student_teacher_ratio"))
    ratio = F.when(stored != 0, stored).otherwise(F.bround(pupils / teachers, 1))
    staff = F.concat(F.lit(" and employed about "), teachers.cast("string"), F.lit(" teachers, a student–teacher ratio of roughly "), F.format_string("%.1f", ratio), F.lit(":1"))
    start = F.concat(F.lit(f"As of the {year} school year, it enrolled "), F.format_number(pupils, 0), F.lit(" students"))
    return F.when(pupils != 0, F.concat(start, F.when(teachers != 0, staff).otherwise(""), F.lit(".")))


def sentence(*parts) -> Column:  # noqa: ANN002
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def joined(clauses: list[Column]) -> Column:
    return F.trim(X.replace_all(F.concat_ws(" ", *clauses), [(r"\s+", " "), (" ,", ",")]))


def public_article(r: dict[str, Column], year: str = YEARS["public"]) -> Column:
    """At most seven sentences on a public school, each but the first only where its fields are known."""
    of = lambda n: field(r, n)
    known = lambda c, s: F.when(c, s)
    name = title_case(of("school_name"))
    name = F.when(name == "", "This school").otherwise(name)
    city, county, state = title_case(of("city")), title_case(of("county")), state_name(of("state"))
    lo, hi = grade(of("low_grade")), grade(of("high_grade"))
    both = (lo != "") & (hi != "")
    level = F.when(both, level_word(lo, hi)).otherwise("")
    lead = sentence(name, " is a public ", F.when(of("Charter") == "Yes", "charter ").otherwise(""), F.coalesce(H.lookup(PUBLIC_TYPES, of("type")), F.lit("")), level, "school", place(city, county, state), F.when(both, grades_clause(lo, hi)).otherwise(""), ".")
    district = title_case(district_name(of("District")))
    free, reduced, pupils = (whole(of(n)) for n in ("Free Lunch", "Reduced Lunch", "total_students"))
    eligible = F.coalesce(free, F.lit(0)) + F.coalesce(reduced, F.lit(0))
    percent = F.bround(eligible / pupils * 100, 0).cast("long").cast("string")
    address, code, phone = title_case(of("address")), of("zip"), of("phone")
    street = sentence("Its street address is ", address, ", ", city, ", ", of("state"), F.when(code != "", F.concat(F.lit(" "), code)).otherwise(""), F.when(phone != "", F.concat(F.lit(", and its phone number is "), phone)).otherwise(""), ".")
    return joined([
        lead,
        known((district != "") & ~F.contains(F.lower(name), F.lower(district)), sentence("It is part of ", district_phrase(district), ".")),
        sentence("It is located in ", H.lookup(PUBLIC_PLACES, of("Locale")), "."),
        known(of("Status") == "New", F.lit(f"It opened in the {year} school year.")),
        size_clause(r, year),
        known((pupils != 0) & ((F.coalesce(free, F.lit(0)) != 0) | (F.coalesce(reduced, F.lit(0)) != 0)), sentence("About ", percent, "% of students were eligible for free or reduced-price lunch.")),
        known((address != "") & (city != "") & (state != ""), street),
    ])


def affiliations(r: dict[str, Column]) -> Column:
    """The distinct names in the fields PSS_ASSOC_1 to 15, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[field(r, f"PSS_ASSOC_{i}") for i in range(1, 16)]), lambda x: x != "")))


def private_article(r: dict[str, Column], year: str = YEARS["private"]) -> Column:
    """The same for a private school, from the survey's codes."""
    of = lambda n: field(r, n)
    word = lambda table, n: F.coalesce(H.lookup(table, of(n)), F.lit(""))
    name = title_case(of("school_name"))
    name = F.when(name == "", "This school").otherwise(name)
    city, county, state = title_case(of("city")), title_case(of("county")), state_name(of("state"))
    county = F.when((county != "") & ~F.contains(F.lower(county), F.lit("county")), F.concat(county, F.lit(" County"))).otherwise(county)
    present = F.array_compact(F.array(*[F.when(F.coalesce(whole(of(f"PSS_ENROLL_{g}")), F.lit(0)) != 0, g) for g in GRADES]))
    lo, hi = F.coalesce(F.get(present, 0), F.lit("")), F.coalesce(F.try_element_at(present, F.lit(-1)), F.lit(""))
    kind = F.array_join(F.filter(F.array(word(SEXES, "PSS_COED"), word(RELIGIONS, "PSS_RELIG")), lambda x: x != ""), " ")
    lead = sentence(name, " is a ", F.when(kind != "", F.concat(kind, F.lit(" "))).otherwise(""), "private ", word(PRIVATE_TYPES, "type"), word(PRIVATE_LEVELS, "PSS_LEVEL"), "school", place(city, county, state), grades_clause(lo, hi), ".")
    shares = F.filter(F.array(*[F.struct((-one_decimal(of(c))).alias("p"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(RACES.items())]), lambda x: F.coalesce(x["p"] < 0, F.lit(False)))
    body = listed(F.transform(F.array_sort(shares), lambda x: F.concat(share(-x["p"]), F.lit("% "), x["n"])))
    days, hours = whole(of("PSS_SCH_DAYS")), one_decimal(of("PSS_STU_DAY_HRS"))
    session = sentence("is in session about ", days.cast("string"), " days a year", F.when(hours != 0, F.concat(F.lit(", "), share(hours), F.lit(" hours a day"))).otherwise(""))
    says = F.array_compact(F.array(F.when(of("PSS_LIBRARY") == "Yes", "has a library").when(of("PSS_LIBRARY") == "No", "does not have a library"), F.when(days != 0, session)))
    address, code = title_case(of("address")), of("zip")
    street = sentence("Its street address is ", address, ", ", city, ", ", of("state"), F.when(code != "", F.concat(F.lit(" "), code)).otherwise(""), ".")
    return joined([
        lead,
        sentence("It is located in ", H.lookup(PRIVATE_PLACES, of("PSS_LOCALE")), "."),
        size_clause(r, year),
        sentence("Its student body was ", body, "."),
        F.when(F.size(says) > 0, sentence("The school ", F.array_join(says, " and "), ".")),
        sentence("It reports affiliation with ", listed(affiliations(r)), "."),
        F.when((address != "") & (city != "") & (state != ""), street),
    ])


def article(r: dict[str, Column]) -> Column:
    return F.when(field(r, "sector") == "private", private_article(r)).otherwise(public_article(r))


# -- fact sheets: a record's rows, research on top of them, as cells of Markdown

#: The rows of a sheet in order; the first seven come from the record.
FACTS = ("Official name", "School type", "Grades", "District", "Address", "Enrollment", "Teachers", "Official website", "Year opened", "Mascot", "School colors", "Named after", "Former names", "Programs", "Awards and recognitions")
NOT_FOUND = r"(?i)^\*?(not found|none found)\b"
SOURCES = "array<struct<label:string,url:string>>"


def long_date(iso: Column) -> Column:
    """2026-10-01 as October 1, 2026; null if it is no date."""
    return F.date_format(iso.try_cast("date"), "MMMM d, yyyy")


def link(label: str, url: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), url.alias("url"))


def record_rows(r: dict[str, Column], record: Column, directory: Column, magnet: Column) -> Column:
    """array<struct<value, sources>> of a public record's seven rows. record, directory: links; directory is null where a school isn't in it; magnet: N if it says no."""
    of = lambda n: field(r, n)
    years = F.lit(YEARS["public"].replace("-", "–"))
    one = F.array(record)
    both = F.when(directory.isNotNull(), F.array(record, directory)).otherwise(one)
    lo, hi = grade(of("low_grade")), grade(of("high_grade"))
    charter = of("Charter") == "Yes"
    kind = sentence("Public ", F.when(charter, "charter ").otherwise(""), F.coalesce(H.lookup(PUBLIC_TYPES, of("type")), F.lit("")), level_word(lo, hi), "school", F.when(~charter & F.coalesce(magnet == "N", F.lit(False)), " (not charter, not magnet)").otherwise(""))
    district = title_case(district_name(of("District")))
    has_word = F.lower(district).rlike("district|unified|schools")
    teachers, pupils = whole(of("teachers")), whole(of("total_students"))
    rows = [
        (title_case(of("school_name")), one),
        (kind, both),
        (F.concat_ws("–", lo, hi), both),
        (F.when(has_word, district).otherwise(F.concat(district, F.lit(" School District"))), one),
        (sentence(title_case(of("address")), ", ", title_case(of("city")), ", ", of("state"), " ", of("zip")), both),
        (F.coalesce(sentence(F.format_number(pupils, 0), " students (", years, ")"), F.lit("*Not found*")), one),
        (F.when(teachers != 0, sentence(teachers.cast("string"), " (full-time equivalent, ", years, ")")).otherwise("*Not found*"), one),
    ]
    return F.array(*[F.struct(v.alias("value"), s.cast(SOURCES).alias("sources")) for v, s in rows])


def sheet_rows(facts: Column, record: Column, opened: Column, directory: Column) -> Column:
    """array<struct<fact, value, sources>>: research's rows (fact, value, sources), the first of them filled from the record where research says nothing.

    A year that research didn't find gets the directory's opening date and link, if it has one and the value doesn't name the directory.
    """
    n = F.size(record)

    def row(f: Column, i: Column) -> Column:
        own = F.coalesce(f["value"], F.lit("")) != ""
        given = F.get(record, i)
        late = (i >= n) & (f["fact"] == "Year opened") & f["value"].rlike(NOT_FOUND) & opened.isNotNull() & ~F.contains(f["value"], F.lit("state directory"))
        late = F.coalesce(late, F.lit(False))
        value = F.when((i < n) & ~own, given["value"]).when(late, sentence(f["value"], " (state directory open date: ", long_date(opened), ")")).otherwise(f["value"])
        sources = F.when((i < n) & ~own, given["sources"]).when(late, F.concat(f["sources"], F.array(directory))).otherwise(f["sources"])
        return F.struct(f["fact"].alias("fact"), value.alias("value"), sources.cast(SOURCES).alias("sources"))

    return F.transform(facts, row)


def source_cell(sources: Column) -> Column:
    """[label](url); label — or a dash without sources."""
    shown = F.transform(sources, lambda s: F.when(F.coalesce(s["url"], F.lit("")) != "", F.concat(F.lit("["), s["label"], F.lit("]("), s["url"], F.lit(")"))).otherwise(s["label"]))
    return F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, "—").otherwise(F.array_join(shown, "; "))


def sheet_table(rows: Column) -> Column:
    """The rows as a numbered Markdown table."""
    head = F.array(F.lit("| # | Fact | Value we found | Source | Your review | Correction or source link |"), F.lit("| --- | --- | --- | --- | --- | --- |"))
    lines = F.transform(rows, lambda r, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), r["fact"], F.lit(" | "), r["value"], F.lit(" | "), source_cell(r["sources"]), F.lit(" |  |  |")))
    return F.array_join(F.concat(head, lines), "\n")


def plain_value(c: Column) -> Column:
    """A cell without links and emphasis, "your website" as "the school website"."""
    return F.trim(X.replace_all(c, [(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", "$1"), (r"(?i)\byour website('s)?", "the school website$1"), (r"\*+", "")]))


def page_facts(rows: Column) -> tuple[Column, Column]:
    """(facts: array of fact, plain value and linked sources; missing: array of the facts that weren't found)."""
    lost = lambda r: F.coalesce(r["value"].rlike(NOT_FOUND), F.lit(False))
    shown = lambda r: F.struct(r["fact"].alias("f"), plain_value(r["value"]).alias("v"), F.filter(r["sources"], lambda s: F.coalesce(s["url"], F.lit("")) != "").alias("s"))
    return F.transform(F.filter(rows, lambda r: ~lost(r)), shown), F.transform(F.filter(rows, lost), lambda r: r["fact"])


def read_table(sheet: Column) -> Column:
    """array<struct<fact, value, source>>: a sheet's numbered rows, read back."""
    lines = F.transform(F.split(F.coalesce(sheet, F.lit("")), "\n"), lambda l: F.transform(F.split(F.regexp_replace(F.trim(l), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    rows = F.filter(lines, lambda c: (F.size(c) >= 4) & F.get(c, 0).rlike("^[0-9]+$"))
    return F.transform(rows, lambda c: F.struct(F.get(c, 1).alias("fact"), F.get(c, 2).alias("value"), F.get(c, 3).alias("source")))


def segments(cell: Column) -> Column:
    """array<struct<text, url, italic>> of a cell: links, *emphasis*, bare addresses as links, and what stands between."""
    token = r"\[([^\]]+)\]\((https?://[^)\s]+)\)|\*([^*]+)\*|(?:(?!\[[^\]]+\]\(https?://[^)\s]+\)|\*[^*]+\*).)+"
    whole_token = F.regexp_extract_all(cell, F.lit(rf"(?s){token}"), F.lit(0))
    part = lambda t, p, i: F.nullif(F.regexp_extract(t, rf"(?s)^(?:{p})$", i), F.lit(""))
    link_pattern, mark = r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r"\*([^*]+)\*"

    def one(t: Column) -> Column:
        label, url, slant = part(t, link_pattern, 1), part(t, link_pattern, 2), part(t, mark, 1)
        bare = F.when(F.trim(t).rlike(r"^https?://\S+$"), F.trim(t))
        return F.struct(F.coalesce(label, slant, t).alias("text"), F.coalesce(url, bare).alias("url"), (slant.isNotNull() & label.isNull()).alias("italic"))

    return F.transform(whole_token, one)
