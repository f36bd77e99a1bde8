"""What names, places and grade spans say about schools: states, levels, type words, and whether two of them can be one. All native."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

#: Names and FIPS numbers of the states, the district and five territories.
NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "AS": "American Samoa",
    "GU": "Guam", "MP": "Northern Mariana Islands", "PR": "Puerto Rico", "VI": "United States Virgin Islands",
}
FIPS = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08", "CT": "09", "DE": "10", "DC": "11", "FL": "12", "GA": "13", "HI": "15",
    "ID": "16", "IL": "17", "IN": "18", "IA": "19", "KS": "20", "KY": "21", "LA": "22", "ME": "23", "MD": "24", "MA": "25", "MI": "26", "MN": "27",
    "MS": "28", "MO": "29", "MT": "30", "NE": "31", "NV": "32", "NH": "33", "NJ": "34", "NM": "35", "NY": "36", "NC": "37", "ND": "38", "OH": "39",
    "OK": "40", "OR": "41", "PA": "42", "RI": "44", "SC": "45", "SD": "46", "TN": "47", "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53",
    "WV": "54", "WI": "55", "WY": "56", "AS": "60", "GU": "66", "MP": "69", "PR": "72", "VI": "78",
}
#: Other spellings of names, for whole fields and within texts, and the names that take "the" in prose.
OTHER_NAMES = {"virgin islands": "VI", "u.s. virgin islands": "VI", "us virgin islands": "VI", "washington, d.c.": "DC", "washington d.c.": "DC"}
OTHER_TEXT_NAMES = {"U.S. Virgin Islands": "VI", "Washington, D.C.": "DC", "Washington D.C.": "DC"}
PROSE_NAMES = {"DC": "the District of Columbia", "MP": "the Northern Mariana Islands", "VI": "the U.S. Virgin Islands"}
TERRITORIES = ("AS", "GU", "MP", "PR", "VI")

#: Words of names that tell no school from another.
GENERIC = (
    "school", "schools", "high", "elementary", "middle", "primary", "secondary", "intermediate", "junior", "senior", "the", "of", "a", "and", "at",
    "for", "prep", "preparatory", "academy", "institute", "center", "centre", "es", "ms", "hs", "elem", "sch", "district", "campus", "program",
    "education", "charter", "community", "public", "virtual", "online", "magnet", "regional", "county", "city", "unified", "union", "free", "mesivta",
    "mesifta", "yeshiva", "yeshivat", "bais", "beis", "beth",
)
#: Type words by family, and level words by level.
TYPE_FAMILIES = {
    "online": ("virtual", "online", "cyber"),
    "charter": ("charter", "chtr"),
    "academy": ("academy", "academies", "acad"),
    "program": ("program", "programs"),
    "center": ("center", "centre", "ctr"),
    "montessori": ("montessori",),
    "magnet": ("magnet",),
    "career": ("career", "technical", "technology", "tech", "vocational", "polytech", "polytechnic"),
    "alternative": ("alternative", "alt"),
    "prep": ("preparatory", "prep"),
    "institute": ("institute",),
    "conservatory": ("conservatory",),
}
LEVEL_WORDS = {"high": ("high", "senior", "secondary", "hs"), "middle": ("middle", "junior", "ms"), "elementary": ("elementary", "primary", "elem", "es")}
#: Disambiguators that name no place, cities that bind to none, and words of city names that don't count.
NO_PLACES = ("school", "high school", "academy", "private school", "public school")
FREE_CITIES = ("new york", "manhattan", "brooklyn", "queens", "bronx", "the bronx", "staten island")
CITY_FILLER = (
    "city", "township", "town", "village", "borough", "north", "south", "east", "west", "new", "saint", "fort", "port", "mount", "lake", "upper",
    "lower", "the", "of",
)


def lookup(table: dict[str, str], c: Column) -> Column:
    """The value of c in a small fixed table; null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), c)


def by_word(families: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {w: k for k, ws in families.items() for w in ws}


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(norm: Column) -> Column:
    return F.filter(F.split(blank(norm), " "), lambda w: w != "")


def state_code(c: Column) -> Column:
    """The code of a code or name in any case; '' if unknown."""
    s = F.trim(blank(c))
    return F.when(F.upper(s).isin(*NAMES), F.upper(s)).otherwise(F.coalesce(lookup({n.lower(): k for k, n in NAMES.items()} | OTHER_NAMES, F.lower(s)), F.lit("")))


def state_in_text(c: Column) -> Column:
    """The full name of the state that a text names, the longest name first; ''."""
    spellings = {n: k for k, n in NAMES.items()} | OTHER_TEXT_NAMES
    order = sorted(spellings, key=lambda n: (-len(n), n))
    return F.coalesce(*[F.when(F.contains(blank(c), F.lit(n)), F.lit(NAMES[spellings[n]])) for n in order], F.lit(""))


def title_city(c: Column) -> Column:
    """Of "Name (City, State)" the city in lower case; ''."""
    return F.lower(F.trim(F.split(X.parenthesised(c), ",")[0]))


def explicit_city(c: Column) -> Column:
    """As title_city, but '' for a bare state, a word for schools, or digits."""
    inner = F.lower(X.parenthesised(c))
    none = inner.isin(*[n.lower() for n in NAMES.values()], *OTHER_NAMES, *NO_PLACES) | inner.rlike("[0-9]")
    return F.when(F.contains(inner, F.lit(",")), F.trim(F.split(inner, ",")[0])).when(none, "").otherwise(inner)


def core(norm: Column) -> Column:
    """The distinctive words of a normal name, in order."""
    return F.array_join(F.filter(words(norm), lambda w: ~w.isin(*GENERIC)), " ")


def type_families(norm: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(words(norm), lambda w: lookup(by_word(TYPE_FAMILIES), w))))


def name_levels(norm: Column) -> Column:
    """Levels that a name's words state; the middle of "middle college" is none."""
    w = words(norm)
    level = lambda x, i: F.when((x == "middle") & (F.coalesce(F.get(w, i + 1), F.lit("")) == "college"), F.lit(None)).otherwise(lookup(by_word(LEVEL_WORDS), x))
    return F.array_distinct(F.array_compact(F.transform(w, level)))


def public_grade(c: Column) -> Column:
    """-1 for PK, 0 for K and KG, 1 to 12; null for other codes."""
    code = F.upper(F.trim(blank(c)))
    n = F.when(code.rlike("^[0-9]+$"), code).try_cast("int")
    return F.when(code == "PK", -1).when(code.isin("K", "KG"), 0).when(n.between(1, 12), n)


def enrolled_span(counts: list[Column]) -> tuple[Column, Column]:
    """First and last grade with pupils; counts: of PK, K, 1 to 12, as text."""
    grades = F.array_compact(F.array(*[F.when(c.try_cast("double") > 0, F.lit(i - 1)) for i, c in enumerate(counts)]))
    return F.get(grades, 0), F.try_element_at(grades, F.lit(-1))


def span_levels(lo: Column, hi: Column) -> Column:
    """Levels of the grades lo to hi: elementary to 5, middle to 8, high; none if the span is unknown."""
    ok = lo.isNotNull() & hi.isNotNull() & (lo <= hi)
    have = F.array(F.when(ok & (lo <= 5), "elementary"), F.when(ok & (lo <= 8) & (hi >= 6), "middle"), F.when(ok & (hi >= 9), "high"))
    return F.array_compact(have)


def evaluation_level(lo: Column, hi: Column) -> tuple[Column, Column]:
    """The level, and another that is accepted for it."""
    known = lo.isNotNull() & hi.isNotNull()
    level = F.when(known & (hi <= 6), "elementary").when(known & (lo >= 9), "high").when(known & (lo >= 5) & (hi <= 8), "middle").when(known, "combined")
    return level, F.when((level == "combined") & (hi >= 12) & (lo >= 6), "high")


def text_level(c: Column) -> Column:
    """The first of high, middle, elementary and combined that a text has words for; ''."""
    t = F.lower(blank(c))
    #: The words of each level.
    return F.when(t.rlike("high school|secondary|senior high"), "high").when(t.rlike("middle school|junior high|intermediate school"), "middle").when(t.rlike("elementary|primary school|grade school|grammar school"), "elementary").when(t.rlike("k[–-](12|8)"), "combined").otherwise("")


def overlap_or_open(a: Column, b: Column) -> Column:
    """True unless both are known and have nothing in common."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def city_compatible(title: Column, city: Column) -> Column:
    a, b = X.norm_name(title), X.norm_name(city)
    rest = lambda c: F.filter(words(c), lambda w: ~w.isin(*CITY_FILLER))
    return (a == "") | (b == "") | (a == b) | a.isin(*FREE_CITIES) | F.coalesce(F.arrays_overlap(rest(a), rest(b)), F.lit(False))


def types_compatible(a: Column, b: Column) -> Column:
    return overlap_or_open(type_families(a), type_families(b))


def levels_compatible(claimed: Column, span: Column, named: Column) -> Column:
    """claimed levels against those of a grade span or, without one, of the name."""
    return overlap_or_open(claimed, F.when(F.size(span) > 0, span).otherwise(named))


def only_town_agrees(norm: Column, city: Column, other: Column) -> Column:
    """The distinctive words are only the town's, and the type words (but charter and magnet) differ."""
    place = words(X.norm_name(city))
    types = lambda c: F.array_sort(F.array_except(type_families(c), F.array(F.lit("charter"), F.lit("magnet"))))
    return (F.size(F.array_except(words(core(norm)), place)) == 0) & (types(norm) != types(other))


def inside_other_school(norm: Column, other: Column) -> Column:
    """The other is "X at Y", and the name shares long words with Y alone."""
    at = lambda c: F.concat(F.lit(" "), blank(c), F.lit(" "))
    parts = F.split(at(other), " at ", 2)
    mine = X.significant_tokens(words(core(norm)))
    shares = lambda c: F.coalesce(F.arrays_overlap(mine, X.significant_tokens(words(core(c)))), F.lit(False))
    return F.contains(at(other), F.lit(" at ")) & ~F.contains(at(norm), F.lit(" at ")) & shares(F.get(parts, 1)) & ~shares(parts[0])


#: Title namespaces, disambiguators of works, words of churches and schools, prefixes of lists.
NAMESPACES = "Template|Portal|Wikipedia|Draft|Module|Help|Category|File|User|MediaWiki|Talk"
WORKS = r"(?i)\(([0-9]{4} )?film\)|\(TV series\)|\(song\)|\(album\)|\(band\)|\(novel\)|\(disambiguation\)"
CHURCHES = r"(?i)\b(church|cemetery|chapel|congregation)\b"
SCHOOLISH = "(?i)school|academ|yeshiv|institute|seminary|montessori"
ACCREDITATION = "(?i)accredit|commission on|association of"
LISTS = ("List of ", "Lists of ", "Index of ", "Outline of ", "Timeline of ")


def title_dropped(title: Column, category: Column, accreditors: bool = True) -> Column:
    """Not an article on a school: another namespace, a work, a church or cemetery that is no school; with accreditors, out of their categories."""
    out = title.rlike(f"^({NAMESPACES}):") | title.rlike(WORKS) | (title.rlike(CHURCHES) & ~title.rlike(SCHOOLISH))
    return F.coalesce(out | (blank(category).rlike(ACCREDITATION) if accreditors else F.lit(False)), F.lit(False))


def is_list(title: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in LISTS]), lambda p: F.startswith(blank(title), p))


#: Stems of branches that aren't followed.
BRANCH_STOPS = (
    "universit", "community college", "junior college", "technical college", "law school", "medical school", "nursing school", "business school",
    "graduate school", "art school", "divinity", "seminar", "alumni", "faculty", "people educated", "people associated", "educators", "teachers",
    "headmasters", "heads of", "principals", "school shootings", "shootings", "attacks on", "school fires", "school board", "lists of",
    "national register", "historic places", "sport", "athletic", "football", "basketball", "baseball", "mascot", "stadium", "gymnasium", "yearbook",
    "student newspaper", "school buildings", "buildings and structures", "campuses", "architecture", "establishments in", "disestablishments in",
    "introductions", "in fiction", "fictional", "popular culture", "film", "radio station", "television station", "novel", "song", "video game",
    "discograph", "template", "stubs", "wikipedia", "wikiproject", "tracking categories",
)


def descends(category: Column, defunct: bool = False) -> Column:
    """Whether a branch of categories is followed: it is of schools, no college but a preparatory one, not defunct, and has no stop at a word's start."""
    name = F.lower(F.regexp_replace(category, "^Category:", ""))
    ok = name.rlike("school|academ|yeshiv") & ~(F.contains(name, F.lit("college")) & ~F.contains(name, F.lit("prep"))) & ~name.rlike(rf"\b({'|'.join(BRANCH_STOPS)})")
    return F.coalesce(ok if defunct else ok & ~name.rlike(r"\bdefunct"), F.lit(False))


def eligible(d: dict[str, Column], *, types: tuple[str, ...], statuses: tuple[str, ...], methods: tuple[str, ...], any_method: bool = True, need_high: bool = False, drop_territories: bool = True, need_lunch: bool = True) -> Column:
    """The row mask of an evaluation frame; a rule on an unknown value doesn't hold, and its negation does."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    public = yes(d["sector"] == "public")
    ok = d["level"].isNotNull() & d["locale"].isNotNull() & d["enrollment"].isNotNull() & yes(d["city"] != "") & d["state"].isNotNull()
    ok = ok & ~(public & ~yes(d["type"].isin(*types))) & ~(public & ~yes(d["status"].isin(*statuses)))
    if need_high:
        ok = ok & yes(d["hi"] >= 12)
    if drop_territories:
        ok = ok & ~yes(d["state"].isin(*TERRITORIES))
    if need_lunch:
        ok = ok & ~(public & d["lunch"].isNull())
    return ok & ~(yes(d["listed"] == 1) & ~yes(d["method"].isin(*methods))) if any_method else ok
