"""Ordered rules that tag records and say why. Word patterns are parameters; each output column is one chain of conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.schools import state_in_text
from tallyloom.functions.text import replace_all


@dataclass(frozen=True)
class Words:
    """Patterns (Java, case-insensitive) for kinds of things that labels name."""

    #: Schools, districts, higher education (but not preparatory schools) and events at schools.
    kind: str = r"school|academ|gymnasium|yeshiv|lyceum|montessori|seminar|kindergarten|preparat|educational institution"
    district: str = r"school district"
    higher: str = r"^(?!.*preparat).*(\bcollege\b|\buniversity\b|law school|medical school|graduate school|business school|nursing school|art school|dental school|veterinary school|divinity school|community college|junior college)"
    event: str = r"shooting|massacre|bombing|attack|murder|killing|stabbing|disaster|riot|hostage|kidnap|hoax"


def has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def any_label(labels: Column, *, yes: str, no: tuple[str, ...] = ()) -> Column:
    def good(x: Column) -> Column:
        out = has(x, yes)
        for n in no:
            out = out & ~has(x, n)
        return out

    return F.coalesce(F.exists(labels, good), F.lit(False))


def classify(qid: Column, labels: Column, dissolved: Column, w: Words = Words()) -> Column:
    """unverified, school, defunct, out_of_scope or non_school. A genuine label wins over others beside it."""
    genuine = any_label(labels, yes=w.kind, no=(w.district, w.higher, w.event))
    blank = F.coalesce(qid, F.lit("")) == ""
    gone = F.coalesce(dissolved, F.lit("")) != ""
    return (
        F.when(blank | (F.coalesce(F.size(labels), F.lit(0)) <= 0), "unverified")
        .when(genuine & gone, "defunct")
        .when(genuine, "school")
        .when(any_label(labels, yes=f"{w.district}|{w.higher}"), "out_of_scope")
        .otherwise("non_school")
    )


#: Abbreviations whose dot ends no sentence, and what opening sentences, descriptions, types and categories say.
DOTTED = r"(?i)\b(St|Sts|Ste|Mt|Dr|Jr|Sr|No|Ft|Rev|Msgr|Sen|Gen|Pres|Ave|Blvd|Rd|Hwy|Co|Inc|Corp|Bros)\."
LEAD_FORMER = r"(is|are)\s+(an?|the)\s+(former|defunct|closed|historic\b[^.]{0,60}?\b(building|schoolhouse|site|structure|district))\b"
LEAD_BUILT = r"\b(was|were)\s+(built|constructed|erected|designed)\b"
LEAD_HISTORIC = r"\b(is|are)\s+(an?|the)\s+historic\b"
LEAD_CONCEPT = r"\b(is|are)\s+(an?|the)\s+(type|kind|form|style|model)\s+of\b"
LEAD_SUBJECT = r"(?i)\b(?:is|are)\s+(?:an?|the)\s+([^.]{0,200})"
BELONGS = r"^(?:\S+\s+){0,2}?(part|member|campus|division|unit|branch|work|ministry)\s+of\b"
PHRASE_END = r"(?i)\s(?:in|of|on|at|for|from|to|by|with|within|under|near|located|based|headquartered|serving|that|which|who|where|founded|established|operated|run|owned|and\s+(?:is|was))\b"
HEADS = r"schools?\s+(?:network|district|system|corporation)|charter\s+(?:network|management)|network|system|district|organization|organisation|group|schools?|academy|institute|institution|college|university|seminary|yeshiva|conservatory|center|centre|complex|campus|program|programme"
NETWORK_HEADS = r"^(schools?\s+(network|district|system|corporation)|charter\s+(network|management)|network|system|district|organi[sz]ation|group)$"
SCHOOL_HEADS = ("school", "schools", "academy", "institute", "institution", "college", "yeshiva", "center", "centre", "complex", "campus", "program", "programme")
K12_TYPES = r"\b(high|middle|elementary|primary|secondary|junior high|senior high|charter|public|private|boarding|magnet|preparatory|parochial|catholic|montessori|k-12|early college high|comprehensive)\s+school\b"
SCHOOL_WORDS = r"\b(school|academy|yeshiva|montessori|lyceum|gymnasium)\b"
HIGHER = r"(?!.*(prep|k-12|k–12|high school))\b(university|college|seminary|theological|institute of technology)\b"
NETWORK = r"^(?:\S+\s+){0,3}?(network|district|school system|organization|organisation|board of education|group of schools)\b(?!\s+(?:school|high|academy))"
ONE_SCHOOL = r"\b(school|academy|institute)\b(?!s)"
BUILDINGS = r"school building|one-room school|rosenwald school|schoolhouse|former school|building|historic|national register|place"
CLOSED_CATEGORY = r"\b(defunct|closed|demolished)\b[^|]*\b(schools?|academ|institutions?)|disestablished in \d{4}|disestablishments in"
HOME = ("united states", "united states of america", "puerto rico", "guam", "american samoa", "northern mariana islands", "united states virgin islands")


def plain_lead(c: Column) -> Column:
    """Without the dots of abbreviations and initials, and without parentheses."""
    return replace_all(F.coalesce(c, F.lit("")), [(DOTTED, "$1"), (r"\b([A-Z])\.", "$1"), (r"\s*\([^)]*\)", "")])


def first_sentence(lead: Column) -> Column:
    return F.split(plain_lead(lead), r"(?<=[.!?])\s", 2)[0]


def tense(lead: Column) -> Column:
    """past, present or '' from the opening sentence; of "is a" and "was a" the earlier decides."""
    first, whole = first_sentence(lead), plain_lead(lead)
    verb = lambda v: rf"(?i)^([^.]{{0,200}}?)\b({v})\s+(an?|the)\b"
    at = lambda v: F.when(first.rlike(verb(v)), F.length(F.regexp_extract(first, verb(v), 1)))
    now, was = at("is|are"), at("was|were")
    return (
        F.when(has(first, rf"\b{LEAD_FORMER}"), "past")
        .when(has(first, LEAD_BUILT) & has(whole, "National Register|historic"), "past")
        .when(was.isNotNull() & (now.isNull() | (was < now)), "past")
        .when(has(first, LEAD_HISTORIC), "")
        .when(now.isNotNull(), "present")
        .otherwise("")
    )


def head_noun(lead: Column, heads: str = HEADS) -> Column:
    """The last of heads in what the first sentence says the subject is, before a preposition or verb; '' if none, or if it says what the subject is part of."""
    subject = F.regexp_extract(first_sentence(lead), LEAD_SUBJECT, 1)
    phrase = F.split(F.concat(F.lit(" "), subject), PHRASE_END, 2)[0]
    last = F.try_element_at(F.regexp_extract_all(phrase, F.lit(rf"(?i)\b({heads})\b(?!-)"), F.lit(1)), F.lit(-1))
    return F.when(has(subject, BELONGS), "").otherwise(F.coalesce(F.lower(last), F.lit("")))


def names_network(lead: Column) -> Column:
    return head_noun(lead).rlike(NETWORK_HEADS)


def building_only(types: Column) -> Column:
    """All types are of buildings, and there is one."""
    some = F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return (F.size(some) > 0) & F.forall(some, lambda x: has(x, BUILDINGS))


def defunct_category(categories: Column) -> Column:
    """The first category of closed schools; ''."""
    return F.coalesce(F.get(F.filter(categories, lambda c: has(c, CLOSED_CATEGORY)), 0), F.lit(""))


def revalidate(df: DataFrame) -> DataFrame:
    """df with state, operating, validation and validation_note rewritten from lead, description, types and dates.

    Columns: title, state, description, lead, instance_of (array), wikidata_qid, country, dissolved,
    defunct_category, crawl_validation, validation; near_state, if there, is the state of the nearest record.
    Starts from crawl_validation where there is one, so a second run changes no tag. Of the tag's rules only the
    first that holds applies.
    """
    c = F.col
    text = lambda n: F.coalesce(c(n), F.lit(""))
    types = F.coalesce(c("instance_of"), F.array().cast("array<string>"))
    v, t, k, h, s = free_columns(df, "v", "t", "k", "h", "s")
    near = F.coalesce(c("near_state"), F.lit("")) if "near_state" in df.columns else F.lit("")
    told = state_in_text(c("description"))
    d = df.withColumns({
        v: F.coalesce(F.nullif(c("crawl_validation"), F.lit("")), c("validation")),
        t: tense(c("lead")),
        k: F.exists(types, lambda x: has(x, K12_TYPES)),
        h: head_noun(c("lead")),
        s: F.when(text("state") != "", c("state")).when(told != "", told).otherwise(near),
    })
    filled = F.when((text("state") == "") & (c(s) != ""), F.when(told != "", "state from description").otherwise("state from coordinates"))
    closed = (text("dissolved") != "") | building_only(types) | has(c("description"), r"\b(former|defunct|closed)\b") | (text("defunct_category") != "") | (c(v) == "defunct")
    before = c("operating") if "operating" in df.columns else F.lit(None).cast("string")
    operating = F.when(c(v) == "redirect", before).when(c(t) == "past", "no").when(c(t) == "present", "yes").when(closed, "no").otherwise("yes")
    joined = F.array_join(types, "|")
    is_school, listed = c(v) == "school", c(v).isin("school", "unverified")
    network = has(c("description"), NETWORK)
    sure = c(k) & has(c("title"), ONE_SCHOOL)
    plural = has(F.regexp_replace(text("title"), r"\s*\(.*\)$", ""), r"\b(schools|academies)$")
    description = F.replace(text("description"), F.lit("college prep"), F.lit(""))
    rules = [
        ("kind_of", listed & has(plain_lead(c("lead")), LEAD_CONCEPT), "non_school"),
        ("abroad", listed & (text("country") != "") & ~F.lower(text("country")).isin(*HOME) & (c(s) == ""), "out_of_scope"),
        ("higher", is_school & ~c(k) & (has(c("description"), HIGHER) | has(joined, HIGHER)) & ~has(description, SCHOOL_WORDS), "out_of_scope"),
        ("plural", is_school & plural & ~c(h).isin(*SCHOOL_HEADS), "out_of_scope"),
        ("network_lead", is_school & c(h).rlike(NETWORK_HEADS) & ~sure, "out_of_scope"),
        ("network", is_school & network & ~sure & ~((c(t) == "present") & (c(h) != "")), "out_of_scope"),
        ("closed", is_school & (text("defunct_category") != "") & (c(t) != "present"), "defunct"),
        ("rescued", c(v).isin("out_of_scope", "non_school", "defunct") & sure & (c(t) == "present") & ~network, "school"),
        ("described", (c(v) == "unverified") & (text("wikidata_qid") != "") & has(c("description"), SCHOOL_WORDS) & ~network & ~has(c("description"), HIGHER), "school"),
    ]
    tag, note = F, F
    for name, holds, new in rules:
        holds = F.coalesce(holds, F.lit(False))
        tag, note = tag.when(holds, new), note.when(holds, name)
    out = {"state": c(s), "operating": operating, "validation": tag.otherwise(c(v)), "validation_note": F.concat_ws("; ", filled, note)}
    return d.withColumns(out).drop(v, t, k, h, s)


def free_columns(df: DataFrame, *names: str) -> list[str]:
    """Names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n = f"_{n}"
        taken.add(n)
        out.append(n)
    return out


def changes(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Counts of (old, new)."""
    a, b = before.select(key, F.col(column).alias("old")), after.select(key, F.col(column).alias("new"))
    return a.join(b, key).groupBy("old", "new").count()
