"""Structure text: files and tables to numbered lines, and lines from atom tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCHED = "structure_id string, text string, reason string"


def open_url(url: str) -> str:
    with urlopen(url, timeout=60) as answer:  # noqa: S310
        return answer.read().decode("utf-8", "replace")


def fetch_structures(urls: DataFrame, fetch: Callable[[str], str] = open_url, fallback: Callable[[str], str] | None = None) -> DataFrame:
    """structure_id (the url), text, reason for each row of ``urls`` (url), fetched where the rows lie. Where ``fetch``
    fails, ``fallback`` has its turn; where both fail, text is null and reason tells why. Feed texts to ``lines``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["url"]:
                text = reason = None
                for attempt in (fetch, fallback):
                    if attempt is None or text is not None:
                        continue
                    try:
                        text, reason = attempt(url), None
                    except (OSError, ValueError) as e:
                        reason = f"{type(e).__name__}: {e}"
                out.append((url, text, reason))
            yield pd.DataFrame(out, columns=["structure_id", "text", "reason"])

    return urls.select("url").mapInPandas(run, FETCHED)


def read_structures(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][bB]") -> DataFrame:
    """structure_id (file path), line_no, line of all structure files below ``path``. A file is one record, so its lines keep their numbers."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return lines(files.select(F.col("_metadata.file_path").alias("structure_id"), F.col("value").alias("text")))


def lines(texts: DataFrame) -> DataFrame:
    """structure_id, line_no (from 1), line; a carriage return before the line end is stripped once."""
    rows = texts.select("structure_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    return rows.select("structure_id", (F.col("n") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def atom_line(record, serial, name, alt, res_name, chain, res_seq, x, y, z, occupancy, element):
    """One ATOM or HETATM line from columns; coordinates are written with three decimals."""
    fixed = lambda c, n, d: F.lpad(F.translate(F.format_number(c, d), ",", ""), n, " ")
    return F.concat(
        F.rpad(record, 6, " "), F.lpad(serial.cast("string"), 5, " "), F.lit(" "), F.rpad(name, 4, " "), F.rpad(alt, 1, " "), F.lpad(res_name, 3, " "), F.lit(" "), F.rpad(chain, 1, " "),
        F.lpad(res_seq.cast("string"), 4, " "), F.lit("    "), fixed(x, 8, 3), fixed(y, 8, 3), fixed(z, 8, 3), fixed(occupancy, 6, 2), F.lit("  0.00          "), F.lpad(element, 2, " "),
    )
