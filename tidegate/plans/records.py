"""Queries on the capture files' records (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators.rowparse import ParsedRecords, RecordFormat, parse_records, scan_result
from tidegate.schema import RECORD_FEATURES, RECORD_FIELDS
from tidegate.sources.tables import read_table

CAPTURE = RecordFormat(
    RECORD_FIELDS,
    {"row_no": "digits", "captured_at": "time", **dict.fromkeys(RECORD_FEATURES, "feature"), "label": "label"},
)


def parsed(spark: SparkSession, d: str) -> ParsedRecords:
    return parse_records(read_table(spark, d, "raw_rows"), CAPTURE, read_table(spark, d, "label_map"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).failures.select("raw_id", "reason", "column_name")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows by device: how many, and the range of one feature."""
    return parsed(spark, d).loaded.groupBy("device").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("Rate").alias("min_rate"), F.max("Rate").alias("max_rate"),
        F.max("captured_at").alias("last_at"),
    )


def p1_scan_result(spark: SparkSession, d: str) -> DataFrame:
    """Per file and column the NaN and infinite fields, long form of the maps of ``scan_result``."""
    per_file = scan_result(parsed(spark, d))
    long = [
        per_file.select("file_path", F.lit(kind).alias("kind"), F.explode(f"{kind}_by_column").alias("column_name", "n_fields"))
        for kind in ("nan", "inf")
    ]
    bad = per_file.select("file_path", F.lit("bad").alias("kind"), F.lit("").alias("column_name"), F.col("n_bad").alias("n_fields"))
    return long[0].unionByName(long[1]).unionByName(bad)


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_scan_result": p1_scan_result}

_READ = """
lines AS (SELECT raw_id, file_path, coalesce(raw_line, '') AS line FROM raw_rows),
judged AS (
  SELECT raw_id, file_path, line,
    regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS quoting_ok,
    regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS raw_fields
  FROM lines),
fields AS (
  SELECT raw_id, file_path, quoting_ok, len(raw_fields) AS n,
    list_transform(raw_fields, lambda v: CASE WHEN v LIKE '"%' THEN replace(v[2:-2], '""', '"') ELSE v END) AS f
  FROM judged),
cells AS (
  SELECT raw_id, file_path, unnest(['flow_duration','Header_Length','Protocol Type','Rate','Srate','Tot sum','Min','AVG','Max']) AS column_name,
    lower(regexp_replace(unnest(f[4:12]), '^[\\s\\x{00a0}\\x{2007}\\x{2009}\\x{200a}\\x{202f}\\x{3000}]+|[\\s\\x{00a0}\\x{2007}\\x{2009}\\x{200a}\\x{202f}\\x{3000}]+$', '', 'g')) AS v
  FROM fields WHERE quoting_ok AND n = 14),
cell_faults AS (
  SELECT raw_id, file_path, column_name,
    CASE WHEN v = '' OR regexp_full_match(v, '[+-]?(nan|na|n/a|n\\.a\\.|null|none|nil|missing)') THEN 'nan'
         WHEN regexp_full_match(v, '[+-]?(inf|infinity|infinite|∞)') THEN 'inf'
         WHEN NOT regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?(e[+-]?[0-9]+)?') THEN 'invalid'
         WHEN try_cast(v AS DOUBLE) IS NULL OR isinf(try_cast(v AS DOUBLE)) THEN 'inf' END AS reason
  FROM cells),
faults AS (
  SELECT raw_id, file_path, CASE WHEN quoting_ok THEN 'column_count' ELSE 'quoting' END AS reason, '' AS column_name
  FROM fields WHERE NOT quoting_ok OR n <> 14
  UNION ALL SELECT raw_id, file_path, reason, column_name FROM cell_faults WHERE reason IS NOT NULL
  UNION ALL SELECT raw_id, file_path, 'invalid', 'row_no' FROM fields
    WHERE quoting_ok AND n = 14 AND NOT regexp_full_match(f[1], '[0-9]+')
  UNION ALL SELECT raw_id, file_path, 'invalid', 'captured_at' FROM fields
    WHERE quoting_ok AND n = 14 AND NOT (regexp_full_match(f[2], '[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]')
      AND try_cast(f[2][1:10] AS DATE) IS NOT NULL)
  UNION ALL SELECT raw_id, file_path, 'invalid', 'label' FROM fields
    WHERE quoting_ok AND n = 14 AND NOT EXISTS
      (SELECT 1 FROM label_map m WHERE m.slug = regexp_replace(lower(f[13]), '[^a-z0-9]', '', 'g')))
"""

SQL = {
    "p1_found": f"WITH {_READ} SELECT raw_id, reason, column_name FROM faults",
    "p1_loaded": f"""WITH {_READ}
        SELECT f[3] AS device, count(*) AS n_rows,
          min(CAST(regexp_replace(trim(f[7]), '^[+]', '') AS DOUBLE)) AS min_rate,
          max(CAST(regexp_replace(trim(f[7]), '^[+]', '') AS DOUBLE)) AS max_rate,
          max(CAST(f[2] AS TIMESTAMP)) AS last_at
        FROM fields WHERE quoting_ok AND n = 14 AND raw_id NOT IN (SELECT raw_id FROM faults) GROUP BY f[3]""",
    "p1_scan_result": f"""WITH {_READ}
        SELECT file_path, reason AS kind, column_name, count(DISTINCT raw_id) AS n_fields FROM faults
          WHERE reason IN ('nan', 'inf') GROUP BY ALL
        UNION ALL
        SELECT file_path, 'bad', '', count(DISTINCT raw_id) FILTER (WHERE reason IN ('nan', 'inf'))
          FROM (SELECT l.raw_id, l.file_path, t.reason FROM lines l LEFT JOIN faults t ON l.raw_id = t.raw_id) GROUP BY file_path""",
}
