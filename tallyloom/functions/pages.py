"""Texts and checks of public pages: descriptions, colours, addresses, submissions, differences between sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of coverage with their colours, the colour from the last bound on, and the levels' scales.
RAMP = [(0.03, (165, 0, 38)), (0.06, (215, 48, 39)), (0.1, (252, 141, 89)), (0.16, (254, 224, 139)), (0.25, (166, 217, 106)), (0.4, (102, 189, 99))]
TOP = (26, 152, 80)
SCALES = {"all": 1.0, "high": 2.0, "middle": 0.15, "elementary": 0.15, "other": 0.4}

# Patterns of an address with or without its scheme, and of a mail address.
URL = r"(?i)^(https?://)?([\w-]+\.)+[a-z]{2,}(/\S*)?$"
MAIL = r"\S+@\S+\.\S+"


def ramp(share: Column, level: str = "all") -> Column:
    """[red, green, blue] of a share, on the level's scale; null for a null share."""
    out = F.lit(list(TOP))
    for bound, colour in reversed(RAMP):
        out = F.when(share < bound * SCALES[level], F.lit(list(colour))).otherwise(out)
    return F.when(share.isNotNull(), out)


def is_url(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(URL), F.lit(False))


def with_scheme(c: Column) -> Column:
    return F.when(F.trim(c).rlike("(?i)^https?://"), F.trim(c)).otherwise(F.concat(F.lit("https://"), F.trim(c)))


def is_mail(c: Column) -> Column:
    return F.coalesce(c.rlike(MAIL), F.lit(False))


def can_submit(sources: Column, flags: Column) -> Column:
    """A source or a flag is given, every source that isn't blank is an address, and so is that of each flag. Both: arrays of addresses."""
    given = F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.coalesce(F.trim(s) != "", F.lit(False)))
    raised = F.coalesce(flags, F.array().cast("array<string>"))
    return (F.size(given) + F.size(raised) > 0) & F.forall(given, is_url) & F.forall(raised, is_url)


def plain(c: Column) -> Column:
    """Markdown without links and emphasis, "your website" as "the school website"."""
    text = F.regexp_replace(c, r"\[([^\]]+)\]\((https?://[^)\s]+)\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\byour website('s)?", "the school website$1"), r"\*+", ""))


def sector_label(private: Column, charter: Column) -> Column:
    return F.when(private, "private").when(charter == "Yes", "public charter").otherwise("public")


def grade_range(low: Column, high: Column) -> Column:
    """Of two grade labels; null if one is null or empty."""
    named = F.when(low == high, F.concat(F.lit("grade "), low)).otherwise(F.concat(F.lit("grades "), low, F.lit(" through "), high))
    return F.when((low != "") & (high != ""), named)


def schema_type(level: Column) -> Column:
    return F.when(level == "elementary", "ElementarySchool").when(level == "middle", "MiddleSchool").when(level == "high", "HighSchool").otherwise("School")


def describe(d: dict[str, Column], year: Column) -> Column:
    """A paragraph of name, sector, level, city, state, district, grades and enrollment; what is null is left out. year: that of the count."""
    level = F.when(d["level"] == "other", "").otherwise(F.concat(d["level"], F.lit(" ")))
    where = F.when(d["district"] != "", F.concat(F.lit(", in the "), d["district"], F.lit(" district"))).otherwise("")
    first = F.concat(d["name"], F.lit(" is a "), d["sector"], F.lit(" "), level, F.lit("school in "), d["city"], F.lit(", "), d["state"], where, F.lit("."))
    serves = F.concat_ws(" and ", F.concat(F.lit("serves "), d["grades"]), F.concat(F.lit("enrolls "), F.format_number(d["enrollment"], 0), F.lit(" students ("), year, F.lit(")")))
    return F.concat(first, F.when(serves != "", F.concat(F.lit(" It "), serves, F.lit("."))).otherwise(""))


def differences(checks: list[tuple[str, Column, Column]]) -> Column:
    """array<string>: "name: a vs b" for each pair that isn't equal, null counted as a value."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{name}: "), shown(a), F.lit(" vs "), shown(b))) for name, a, b in checks]))
