"""Text functions on columns: names, titles, markup, small parsers. All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that names are spelled out by.
ABBREVIATIONS = (("st", "saint"), ("mt", "mount"), ("jr", "junior"), ("sr", "senior"), ("ft", "fort"))
#: Acronyms that title case keeps.
ACRONYMS = ("II", "III", "IV", "HS", "MS", "ES", "STEM", "US", "USA", "NW", "NE", "SW", "SE")


def replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def norm_name(c: Column) -> Column:
    """Lower case, no parenthesised part, "and" for &, abbreviations spelled out, only [a-z0-9] and single spaces."""
    out = replace_all(F.lower(F.coalesce(c, F.lit(""))), [(r"\([^)]*\)", " "), ("&", " and "), ("[^a-z0-9 ]", " "), (" +", " ")])
    words = F.split(F.trim(out), " ")
    spelled = reduce(lambda w, r: F.transform(w, lambda x: F.when(x == r[0], F.lit(r[1])).otherwise(x)), ABBREVIATIONS, words)
    return F.array_join(spelled, " ")


def core_tokens(c: Column, generic: list[str]) -> Column:
    """The words of a normal name that aren't generic, in order, repeats kept."""
    return F.filter(F.split(norm_name(c), " "), lambda w: (w != "") & ~w.isin(*generic))


def significant_tokens(tokens: Column, least: int = 4) -> Column:
    return F.array_distinct(F.filter(tokens, lambda w: F.length(w) >= least))


def parenthesised(c: Column) -> Column:
    """The text in the first parentheses, '' if there are none."""
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"\(([^)]*)\)", 1))


def title_case(c: Column, acronyms: tuple[str, ...] = ACRONYMS) -> Column:
    """Only all-capital text: each word capitalised but the acronyms."""
    words = F.transform(F.split(c, " "), lambda w: F.when(w.isin(*acronyms), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))))
    return F.when((F.upper(c) == c) & c.rlike("[A-Z]"), F.array_join(words, " ")).otherwise(c)


def clean_markup(c: Column) -> Column:
    """Templates (nested to three), links, citation marks and stray brackets go; spaces are squeezed."""
    rules = [(r"\{\{[^{}]*\}\}", "")] * 3 + [(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]]*)\]\]", "$1"), (r"\[[0-9]+\]", ""), (r"\[\[|\]\]|\{\{|\}\}", ""), (r" +([.,;:])", "$1"), (" +", " ")]
    return F.trim(replace_all(c, rules))


def has_markup(c: Column) -> Column:
    return c.rlike(r"\{\{|\}\}|\[\[|\]\]|\[[0-9]+\]")


#: What words and spaces are made of, in any language.
WORD, SPACE = r"\p{L}\p{N}\p{M}_", r"\s\p{Z}\x1c-\x1f\x85"


def closed_opening(c: Column, *, any_case: bool = False) -> Column:
    """The first sentence (of the first 300 characters) says was/were a ..., and no is/are a .... any_case: capitals don't matter.

    With any_case words end where letters, digits and marks of any language end, whatever the Java version takes for a border, and any space counts.
    """
    short = rf"(?<![{WORD}])([A-Z][a-z]{{0,2}})\." if any_case else r"\b([A-Z][a-z]{0,2})\."
    first = F.substring(replace_all(F.coalesce(c, F.lit("")), [(short, "$1")]), 1, 300)
    if any_case:
        past, now = (rf"(?i)^(?:[^.]{{0,199}}[^.{WORD}])?(?:{verb})[{SPACE}]+(?:a|an|the)(?:[^{WORD}]|$)" for verb in ("wa[sſ]|were", "i[sſ]|are"))
    else:
        past, now = (rf"^[^.]{{0,200}}?\b({verb})\s+(a|an|the)\b" for verb in ("was|were", "is|are"))
    return first.rlike(past) & ~first.rlike(now)


def zero_pad(c: Column, width: int = 12) -> Column:
    """Digits padded to width; longer or other text as it is."""
    return F.when(c.rlike("^[0-9]+$") & (F.length(c) < width), F.lpad(c, width, "0")).otherwise(c)


def phone(c: Column) -> Column:
    """(ddd)ddd-dddd if there are ten digits, else as it is."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.regexp_replace(digits, "^(...)(...)(....)$", "($1)$2-$3")).otherwise(c)


def host(c: Column) -> Column:
    return F.lower(replace_all(F.coalesce(c, F.lit("")), [(r"^[a-zA-Z]+://", ""), (r"^www\.", ""), (r"[/?#].*$", "")]))


def utf16_length(c: Column) -> Column:
    return F.floor(F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words, as text."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def ngram_recall(got: Column, target: Column, n: int) -> Column:
    """The share of target's n-grams that got has; null if target has none."""
    t = ngrams(target, n)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, ngrams(got, n))) / F.size(t))


def phrase_count(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in a text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long")


def mask_words(c: Column, kept: list[str]) -> Column:
    """Runs of words that aren't kept become one [X]; marks without a letter or digit stay."""
    marks = F.transform(F.split(F.coalesce(c, F.lit("")), " +"), lambda w: F.when(F.lower(w).isin(*kept) | ~w.rlike("[A-Za-z0-9]"), w).otherwise(F.lit("[X]")))
    return F.array_join(F.aggregate(marks, F.array().cast("array<string>"), lambda a, w: F.when((w == "[X]") & F.coalesce(F.element_at(F.concat(F.array(F.lit("")), a), -1) == "[X]", F.lit(False)), a).otherwise(F.concat(a, F.array(w)))), " ")


def labelled(c: Column, label: str) -> Column:
    """The rest of the line that starts with label and a colon; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?m)^{label}:[ \t]*([^\n]*)", 1)), F.lit(""))


def first_object(c: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def strip_sections(c: Column, headings: list[str]) -> Column:
    """A text without the sections under these headings (and their deeper ones), and without any heading line.

    A heading is a line of equals signs around a name; a section ends at a heading of its level or above.
    """
    line_kind = lambda l: F.length(F.regexp_extract(l, r"^(=+)[^=].*=\s*$", 1))
    name = lambda l: F.lower(F.trim(F.regexp_replace(l, "=", "")))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, l: Column) -> Column:
        level = line_kind(l)
        inside = (s["skip"] > 0) & (level > s["skip"])
        skip = F.when(level == 0, s["skip"]).when(inside, s["skip"]).when(name(l).isin(*headings), level).otherwise(F.lit(0))
        return F.struct(skip.alias("skip"), F.when((level > 0) | (s["skip"] > 0), s["out"]).otherwise(F.concat(s["out"], F.array(l))).alias("out"))

    return F.trim(F.array_join(F.aggregate(F.split(F.coalesce(c, F.lit("")), "\n"), start, step)["out"], "\n"))


def oxford(items: Column) -> Column:
    """a; a and b; a, b, and c; null if there is none."""
    n = F.size(items)
    most = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return F.when(n == 1, last).when(n == 2, F.concat(F.get(items, 0), F.lit(" and "), last)).when(n > 2, F.concat(most, F.lit(", and "), last))


def shares_text(names: list[str], shares: list[Column]) -> Column:
    """Non-zero shares, largest first and else in the given order: "60% a, 30.5% b, and 9.5% c"."""
    items = F.array(*[F.struct((-s).alias("p"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(zip(names, shares, strict=True))])
    kept = F.array_sort(F.filter(items, lambda x: F.coalesce(x["p"] < 0, F.lit(False))))
    number = lambda x: F.regexp_replace(F.format_string("%.4f", -x["p"]), r"\.?0+$", "")
    return oxford(F.transform(kept, lambda x: F.concat(number(x), F.lit("% "), x["n"])))


def clauses(*parts: Column) -> Column:
    """Sentences joined by spaces; one whose fields are missing (null) is left out."""
    return replace_all(F.concat_ws(" ", *parts), [(" +", " "), (r" ,", ",")])


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def continuation(words: Column, target: Column) -> tuple[Column, Column]:
    """Of target's runs of 4 and of 2 words, repeats counted, the share that words has; null where target is too short."""

    def recall(n: int) -> Column:
        runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        have, want = runs(words), runs(target)
        return F.when(F.size(want) > 0, F.size(F.filter(want, lambda g: F.array_contains(have, g))) / F.size(want))

    return recall(4), recall(2)


def continued(generated: Column, target: Column) -> tuple[Column, Column]:
    """Words of a continuation, ten more than the target's at most, and of the target."""
    t = word_list(target)
    return F.slice(word_list(generated), 1, F.size(t) + 10), t
