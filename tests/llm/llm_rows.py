import random

SCHEMA = "doc_id bigint, text string, lang string, source string, copies int, id int, key string, n int, score double, label string, host string, words int"
WORDS = {"en": "the of and to in that is was with for thing over house river stone".split(), "fr": "le la les des est dans pour avec une sur maison pierre où été même".split()}


def row(i, text, lang="en", source="a"):
    """A document with columns whose names the operators use inside."""
    return (i, text, lang, source, 7, 7, "k", 7, 0.5, "x", "h", 3)


def prose(seed, n, lang="en"):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "a", "er", "on", "ing"]) + r.choice(["", "e", "s"]) for _ in range(n))
