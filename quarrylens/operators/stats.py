"""Run statistics, CSV dedup, token costs, resumed work and JSON out of noisy text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrylens.operators.sqlop import SqlOp

# Dollars a million tokens (input low, input high, output low, output high), cached share, tier in tokens.
PRICES = {
    "gemini-1.5-flash": (0.075, 0.15, 0.30, 0.60, 0.25, 128000),
    "gemini-1.5-pro": (3.50, 7.00, 10.50, 21.00, 0.25, 128000),
    "gemini-2.0-flash": (0.10, 0.10, 0.40, 0.40, 0.25, 128000),
    "gemini-2.0-flash-lite": (0.075, 0.075, 0.30, 0.30, 0.25, 128000),
    "gemini-2.5-pro": (1.25, 2.50, 10.00, 15.00, 0.10, 200000),
    "gemini-2.5-flash": (0.15, 0.30, 1.25, 1.875, 0.25, 200000),
    "gemini-3-pro": (2.00, 4.00, 12.00, 18.00, 0.10, 200000),
    "gemini-3-flash": (0.50, 1.00, 3.00, 4.50, 0.10, 200000),
    "gemini-1.0-pro": (0.50, 0.50, 1.50, 1.50, 0.25, 128000),
    "gpt-4o-mini": (0.150, 0.150, 0.600, 0.600, 0.25, 128000),
    "gpt-4-turbo": (10.00, 10.00, 30.00, 30.00, 0.25, 128000),
    "gpt-4o": (2.50, 2.50, 10.00, 10.00, 0.25, 128000),
    "gpt-4": (30.00, 30.00, 60.00, 60.00, 0.25, 128000),
}

#: What a run counts for each repository.
COUNTED = ("queries_analyzed", "annotations_changed", "signatures_changed", "calls_changed", "repositories_modified", "dependents_modified", "indexes_generated", "indexes_dropped")
COUNTERS = SqlOp(
    "The eight counters by repository, and their totals in the row without one.",
    f"SELECT repo, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTED)} FROM {{runs}} GROUP BY ROLLUP (repo)",
)
DEDUPED = SqlOp(
    "Of lines(file, line_no, date, repo, queries, annotations) as text, the first of each (repository in lower case, queries, annotations) of a file, and how many there were. Cells are trimmed, byte order marks go; header lines, blank ones and what stands before a file's first header are left out.",
    """
WITH cells AS (
  SELECT file, line_no, trim(replace(coalesce(date, ''), chr(65279), '')) AS date, trim(replace(coalesce(repo, ''), chr(65279), '')) AS repo,
    trim(replace(coalesce(queries, ''), chr(65279), '')) AS queries, trim(replace(coalesce(annotations, ''), chr(65279), '')) AS annotations
  FROM {lines}
), heads AS (
  SELECT file, min(line_no) AS head FROM cells WHERE lower(date) = 'date' AND lower(repo) = 'repository name' GROUP BY file
)
SELECT c.file, lower(c.repo) AS repo_key, c.queries, c.annotations, min(c.line_no) AS line_no, min_by(c.repo, c.line_no) AS repo, count(*) AS n
FROM cells c JOIN heads h ON h.file = c.file AND c.line_no > h.head
WHERE NOT (lower(c.date) = 'date' AND lower(c.repo) = 'repository name') AND concat(c.date, c.repo, c.queries, c.annotations) <> ''
GROUP BY c.file, lower(c.repo), c.queries, c.annotations""",
)
COSTS = SqlOp(
    "Input and output cost; the tier goes by input tokens for both, cached tokens cost their share.",
    """
SELECT id, CAST(round((input_tokens - cached_tokens) / 1000000.0 * price_in + cached_tokens / 1000000.0 * price_in * cached, 12) AS DOUBLE) AS input_cost,
  CAST(round(output_tokens / 1000000.0 * price_out, 12) AS DOUBLE) AS output_cost
FROM (
  SELECT u.*, p.cached, CASE WHEN u.input_tokens <= p.tier THEN p.in_low ELSE p.in_high END AS price_in, CASE WHEN u.input_tokens <= p.tier THEN p.out_low ELSE p.out_high END AS price_out
  FROM {used} u JOIN {prices} p ON p.model = u.model
) x""",
)
USAGE = SqlOp(
    "Tokens by model and the share of cached ones in percent, 0 without tokens.",
    """
SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(CASE WHEN sum(input_tokens) = 0 THEN 0.0 ELSE round(sum(cached_tokens) * 100.0 / sum(input_tokens), 6) END AS DOUBLE) AS cached_percent
FROM {used} GROUP BY model""",
)
TO_DO = SqlOp(
    "Types still to do: targeted, if any are, not skipped, not done.",
    """
SELECT t.name FROM {types} t
WHERE (NOT EXISTS (SELECT 1 FROM {targets}) OR t.name IN (SELECT g.name FROM {targets} g))
  AND NOT EXISTS (SELECT 1 FROM {skipped} s WHERE s.name = t.name) AND NOT EXISTS (SELECT 1 FROM {done} d WHERE d.name = t.name)""",
)
MAJORITY = SqlOp(
    "The commonest value of each group, ties to the least.",
    """
SELECT grp, value FROM (
  SELECT grp, value, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, value) AS n FROM {pairs} GROUP BY grp, value
) x WHERE n = 1""",
)


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, in_low double, in_high double, out_low double, out_high double, cached double, tier long")


def priced_model(model: str, default: str = "gemini-1.5-flash") -> str:
    """The model whose prices apply: the longest name that ``model`` starts with."""
    return max((m for m in PRICES if model.startswith(m)), key=len, default=default)


def embedded_json(text: str | None) -> str | None:
    """JSON in noisy text: the last fenced part, else from the last bracket that starts a line, else from the first bracket."""
    if not text:
        return None
    if fences := re.findall(r"```(?:json)?\s*\n?(.*?)```", text, re.DOTALL):
        return fences[-1].strip()
    if starts := [m.start() for m in re.finditer(r"^[\[{]", text, re.MULTILINE)]:
        return text[starts[-1] :].strip()
    found = re.search(r"[\[{]", text)
    return text[found.start() :].strip() if found else None


@F.pandas_udf(StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """``embedded_json`` of a column."""
    return pd.Series([embedded_json(t) for t in text], dtype=object)


def unwrapped(json: str):
    """The list in a response: itself, or under recommendations, results, data, else under the first field; of a value that is neither, itself."""
    v = F.try_parse_json(json)
    picks = [F.try_variant_get(v, f"$.{k}", "string") for k in ("recommendations", "results", "data")]
    # the first field as written: a parsed object keeps its fields by name
    first = F.try_element_at(F.json_object_keys(json), F.lit(1))
    under = F.when(F.substring(F.ltrim(json), 1, 1) == "{", F.from_json(json, "map<string,string>")[first])
    return F.coalesce(*picks, under, F.try_variant_get(v, "$", "string"))
