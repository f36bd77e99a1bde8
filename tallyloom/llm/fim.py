"""Fill-in-the-middle: a text is cut into lines, and two line ends drawn from its id part it into prefix, middle, suffix.

The Split pre-tokenizer with the lines' pattern, isolated, gives the code-point offsets of all lines; nothing is trained. The
offsets' number is n, the smaller and the larger draw rank the two offsets at which the text is sliced. Draws and forms are
Spark expressions over the id's digest, so that a rerun gives the same rows. `restored` rebuilds the text from output and form.

A null text counts as empty; an empty text, or one that holds a mark, stays as it is (form plain). A null id is drawn from as an
empty one, and rows that repeat come out alike. Long texts go to the pre-tokenizer in pieces that end with a line: a line's
matches don't depend on what stands before it. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: The units: lines with their line end.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PIECE = 1 << 16


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return K.per_worker("fim lines", lambda: pre_tokenizers.Split(Regex(LINES), "isolated"))


def line_ends(text: str, piece: int = PIECE) -> np.ndarray:
    """The code-point offset after each line."""
    ends, at = [], 0
    while at < len(text):
        to = len(text) if len(text) - at <= piece else (text.rfind("\n", at, at + piece) + 1 or text.find("\n", at + piece) + 1 or len(text))
        ends.append(np.fromiter((e for _, (_, e) in splitter().pre_tokenize_str(text[at:to])), np.int64) + at)
        at = to
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Each row's id, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output; one pass without a shuffle.

    fim_rate: so many of 100 texts are transformed; spm_rate: so many of 100 of these put the suffix first.
    """
    p, s, m = marks
    h = draws(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = (text == "") | (h[2] % 100 >= fim_rate)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = K.packed(batch.column(1))
            for i, j in K.groups(offsets):
                part = batch.slice(i, j - i)
                out = []
                for t, f, a, b in zip(*(part.column(c).to_pylist() for c in range(1, 5)), strict=True):
                    ends = line_ends(t)
                    n = len(ends)
                    if f == "plain":
                        out.append((n, None, None, t))
                        continue
                    at = np.concatenate([[0], ends])
                    low, high = (int(at[r]) for r in sorted((a % (n + 1), b % (n + 1))))
                    pre, mid, suf = t[:low], t[low:high], t[high:]
                    out.append((n, low, high - low, f"{p}{pre}{s}{suf}{m}{mid}" if f == "psm" else f"{s}{suf}{p}{pre}{m}{mid}"))
                n, low, size, made = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), part.column(2), pa.array(low, pa.int64()), pa.array(size, pa.int64()), pa.array(made, pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(cut_up, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle made output of: a transformed text holds none of the marks, so that each mark's first place is its own."""
    p, s, m = marks

    def left(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def right(c: Column, mark: str) -> Column:
        return F.substr(c, F.length(left(c, mark)) + len(mark) + 1)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        rest = right(body, second)
        return left(body, second), left(rest, m), right(rest, m)

    pre, suf, mid = parts(p, s)
    suf2, pre2, mid2 = parts(s, p)
    return F.when(form == "psm", F.concat(pre, mid, suf)).when(form == "spm", F.concat(pre2, mid2, suf2)).otherwise(output)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
