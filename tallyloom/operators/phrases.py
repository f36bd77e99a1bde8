"""Counting many phrases in many texts in one pass over the texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occurrences(automaton: ahocorasick.Automaton, text: str) -> Counter:
    """How often each phrase stands in a text, from left to right, without overlapping itself."""
    n, free = Counter(), {}
    for end, phrase in automaton.iter(text):
        start = end - len(phrase) + 1
        if start >= free.get(phrase, 0):
            n[phrase] += 1
            free[phrase] = end + 1
    return n


def count_phrases(docs: DataFrame, phrases: DataFrame, *, text_col: str = "text", phrase_col: str = "phrase", group: int = 100_000) -> DataFrame:
    """phrase, n: the occurrences of each phrase in all texts; one that never occurs, or is blank, isn't there. Nulls count as blank.

    An automaton of at most about group phrases goes to every task, chosen by hash; more phrases take as many passes. Tasks
    send counts, not places.
    """
    known = phrases.select(F.col(phrase_col).alias("phrase")).where("phrase <> ''").distinct()
    groups = max(1, -(-known.count() // group))
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    out = None
    for g in range(groups):
        own = [r.phrase for r in known.where(F.pmod(F.xxhash64("phrase"), F.lit(groups)) == g).collect()]
        part = texts.mapInPandas(counter(own), "phrase string, n bigint")
        out = part if out is None else out.union(part)
    return out.groupBy("phrase").agg(F.sum("n").alias("n"))


def counter(own: list[str]):  # noqa: ANN201
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for p in own:
            automaton.add_word(p, p)
        automaton.make_automaton()
        n: Counter = Counter()
        for b in batches:
            for text in b["text"] if own else ():
                n.update(occurrences(automaton, text))
        if n:  # the columns of an empty frame would have no type
            yield pd.DataFrame({"phrase": list(n), "n": list(n.values())}).astype({"n": "int64"})

    return run
