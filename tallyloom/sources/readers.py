"""Sources: delimited text, JSON lines, JSON documents, archives, HTML tables, paged services."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.archives import read_zip_members  # noqa: F401


def read_csv(spark: SparkSession, path: str, *, ids: DataFrame | list[str] | None = None, id_col: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as text, header in the first line; ids: only these rows, by a semi-join with a frame that has id_col, or a short list.

    multi_line: fields may hold line ends, so that a file is one task; without it files are split.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    if ids is None:
        return df
    return df.where(F.col(id_col).isin(ids)) if isinstance(ids, list) else df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank and broken lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_release(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, or JSON lines if the path ends in .jsonl."""
    return read_jsonl(spark, path, schema) if path.endswith(".jsonl") else spark.read.parquet(path)


class Rows(HTMLParser):
    """The cells of every table row."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def table_records(html: str, marker: str) -> list[dict[str, str]]:
    """Records below the row that has the cell marker; stars at the end of headers go, and rows without the marker's value."""
    parser = Rows()
    parser.feed(html or "")
    header: list[str] | None = None
    out = []
    for row in parser.rows:
        cells = [c.rstrip("*").strip() for c in row]
        if header is None:
            header = cells if marker in cells else None
        elif (record := dict(zip(header, row, strict=False))).get(marker, "").strip():
            out.append(record)
    return out


def html_tables(pages: DataFrame, html_col: str, key_cols: list[str], marker: str) -> DataFrame:
    """key_cols, row (from 0) and record (map) of each page's table."""
    kind = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in key_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*[r[c] for c in key_cols], i, rec) for r in batch.to_dict("records") for i, rec in enumerate(table_records(r[html_col], marker))]
            yield pd.DataFrame(out, columns=[*key_cols, "row", "record"])

    return pages.select(*key_cols, html_col).mapInPandas(run, f"{kind}, row int, record map<string,string>")


def with_retries(call: Callable[[], dict], *, tries: int = 8, most: float = 60, sleep: Callable[[float], None] = time.sleep) -> dict:
    """call() again after OSError or a reply {"retry_after": s}, waiting longer each time."""
    for k in range(tries):
        try:
            reply = call()
            if "retry_after" not in reply:
                return reply
            wait = float(reply["retry_after"])
        except OSError:
            wait = min(most, 2.0**k)
        if k + 1 < tries:
            sleep(wait)
    raise OSError(f"no reply after {tries} tries")


def paged_lookup(ids: DataFrame, id_col: str, transport: Callable[[list[str], str | None], dict], *, batch: int = 50) -> DataFrame:
    """(id, json) of the records that transport gives for up to batch ids at a time, page after page while it says continue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [str(x) for x in b[id_col]]
            for i in range(0, len(keys), batch):
                token, rows = None, []
                while True:
                    reply = with_retries(lambda part=keys[i : i + batch], t=token: transport(part, t))
                    rows += [(str(k), json.dumps(v)) for k, v in reply["records"].items()]
                    token = reply.get("continue")
                    if token is None:
                        break
                yield pd.DataFrame(rows, columns=["id", "json"])

    return ids.select(id_col).mapInPandas(run, "id string, json string")
