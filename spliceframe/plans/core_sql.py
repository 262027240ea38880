"""SQL (DuckDB) that gives the results of core_queries, written apart from the operators."""

from __future__ import annotations

from spliceframe.plans import junction_sql


def _key(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) NOT IN ('', '.') THEN upper(trim({c})) END"


_TOTALS = """
SELECT {key} AS gene, CAST(count(*) AS BIGINT) AS n_rows, {sums}
FROM {table} WHERE {key} IS NOT NULL GROUP BY 1"""

_FPKM = "fpkm > 0 AND fpkm < 'infinity'::DOUBLE AND NOT isnan(fpkm)"

P1_FOUND = f"""
WITH k AS (
  SELECT 'gene_junc' AS table_name, {_key("gene_name")} AS gene FROM gene_junc
  UNION ALL SELECT 'transcript_result', {_key("gene")} FROM transcript_result
), n AS (SELECT table_name, gene, count(*) AS c FROM k WHERE gene IS NOT NULL GROUP BY ALL),
t AS (SELECT table_name, sum(c) AS s FROM n GROUP BY 1)
SELECT table_name, gene FROM n JOIN t USING (table_name) WHERE c * 50 >= s"""

#: Fields as tabs, quotes and ends of line define them; the checks in their order.
_P3 = r"""
WITH l AS (SELECT *, regexp_replace(raw_line, '\r\z', '') AS line FROM junc_raw WHERE raw_line IS NOT NULL),
r AS (SELECT * FROM l WHERE NOT regexp_full_match(line, ' *') AND NOT starts_with(line, '#')
  AND line <> concat_ws(chr(9), 'chrom', 'chromStart', 'chromEnd', '.', 'score', 'strand')),
q AS (SELECT *, regexp_full_match(line, '(?s)("([^"]|"")*"|[^"\t][^"\t]*|)(\t("([^"]|"")*"|[^"\t]*))*') AS sound FROM r),
f AS (SELECT *, CASE WHEN sound THEN list_transform(regexp_extract_all(chr(9) || line, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1),
  lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END, ' ')) END AS f FROM q),
c AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) NOT IN (6, 12) THEN 'column_count' WHEN f[1] = '' THEN 'chrom'
  WHEN NOT regexp_full_match(f[2], '[0-9]+') OR NOT regexp_full_match(f[3], '[0-9]+') THEN 'coordinate'
  WHEN coalesce(TRY_CAST(f[2] AS HUGEINT), 0) NOT BETWEEN 1 AND 2147483647 THEN 'coordinate'
  WHEN coalesce(TRY_CAST(f[3] AS HUGEINT), 0) NOT BETWEEN 1 AND 2147483647 THEN 'coordinate'
  WHEN NOT regexp_full_match(f[5], '[0-9]+') OR coalesce(TRY_CAST(f[5] AS HUGEINT), -1) NOT BETWEEN 0 AND 2147483647 THEN 'score'
  WHEN f[6] NOT IN ('+', '-', '.', '0', '1') THEN 'strand' END AS reason FROM f)
"""

P4_COMPACTED = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, rec_no ORDER BY written_at DESC NULLS LAST, file_name DESC NULLS LAST,
  chrom DESC NULLS LAST, chrom_start DESC NULLS LAST, chrom_end DESC NULLS LAST, score DESC NULLS LAST, strand DESC NULLS LAST) AS k,
  count(*) OVER (PARTITION BY sample_id, rec_no) AS n_copies FROM junc_parts)
SELECT sample_id, rec_no, chrom, chrom_start, chrom_end, score, strand, n_copies FROM r WHERE k = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_gene_junc_totals": _TOTALS.format(key=_key("gene_name"), table="gene_junc", sums="CAST(sum(score) AS BIGINT) AS sum_score"),
        "p1_transcript_totals": _TOTALS.format(key=_key("gene"), table="transcript_result", sums=f"count(*) FILTER ({_FPKM}) AS n_fpkm, round(sum(fpkm) FILTER ({_FPKM}), 3) AS sum_fpkm"),
        "p3_found": _P3 + "SELECT raw_id, reason FROM c WHERE reason IS NOT NULL",
        "p3_valid_rows": _P3 + "SELECT raw_id, file_name, line_no, f[1] AS chrom, CAST(f[2] AS INT) AS chrom_start, CAST(f[3] AS INT) AS chrom_end, CAST(f[5] AS INT) AS score, f[6] AS strand FROM c WHERE reason IS NULL",
        "p4_found": "SELECT sample_id, rec_no FROM junc_parts GROUP BY ALL HAVING count(*) > 1",
        "p4_compacted": P4_COMPACTED,
        "p4_tiny_files": P4_COMPACTED,
    } | junction_sql.oracle_sql()
