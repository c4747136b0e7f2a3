"""One query text for Spark SQL and, for checking, for DuckDB.

Tables stand in braces; where the dialects differ, the text has a macro NAME[a|b]:
AGG[x|sep|order] ordered string aggregate, SHA[x] SHA-256, US[ts] microseconds since 1970, BIG[x] bigint,
PCT[x|q] interpolated percentile, EVEN[x|n] half-even rounding, LIKE[s|p] regular-expression test,
SUB[s|p|r] replacement of all matches, DIV[a|b] integer division, SEQ[a|b] a row for each integer of [a, b] as column i.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.sources.tables import table

SPARK = {
    "AGG": "listagg({0}, '{1}') WITHIN GROUP (ORDER BY {2})",
    "SHA": "sha2({0}, 256)",
    "US": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0})",
    "BIG": "CAST({0} AS BIGINT)",
    "PCT": "percentile({0}, {1})",
    "EVEN": "bround({0}, {1})",
    "LIKE": "regexp_like({0}, {1})",
    "SUB": "regexp_replace({0}, {1}, {2})",
    "DIV": "({0} div {1})",
    "SEQ": "(SELECT explode(sequence({0}, {1})) AS i)",
}
CHECK = {
    "AGG": "string_agg({0}, '{1}' ORDER BY {2})",
    "SHA": "sha256({0})",
    "US": "epoch_us({0})",
    "BIG": "CAST({0} AS BIGINT)",
    "PCT": "quantile_cont(CAST({0} AS DOUBLE), {1})",
    "EVEN": "round_even({0}, {1})",
    "LIKE": "regexp_matches({0}, {1})",
    "SUB": "regexp_replace({0}, {1}, {2}, 'g')",
    "DIV": "({0} // {1})",
    "SEQ": "(SELECT CAST(unnest(range({0}, {1} + 1)) AS INTEGER) AS i)",
}
MACRO = re.compile(r"\b(" + "|".join(SPARK) + r")\[")


def expanded(text: str, to: dict[str, str]) -> str:
    """Macros replaced, from the innermost out."""
    while (found := list(MACRO.finditer(text))) :
        m = found[-1]
        depth, at, parts, start = 0, m.end(), [], m.end()
        while True:
            c = text[at]
            if c == "[":
                depth += 1
            elif c == "]" and depth:
                depth -= 1
            elif c == "]":
                parts.append(text[start:at])
                break
            elif c == "|" and not depth and text[at + 1] != "|" and text[at - 1] != "|":
                parts.append(text[start:at])
                start = at + 1
            at += 1
        text = text[: m.start()] + to[m[1]].format(*parts) + text[at + 1 :]
    return text


def both(text: str, check: str | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query and the SQL to check it with (`check` where a differently written one is wanted)."""
    spark_text = expanded(text, SPARK)
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_text, **{n: table(spark, sf_dir, n) for n in names})

    plain = expanded(check or text, CHECK).replace("count_if(", "count(*) FILTER (WHERE ")
    for n in names:
        plain = plain.replace("{" + n + "}", n)
    return run, plain
