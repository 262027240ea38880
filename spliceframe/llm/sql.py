"""SQL (DuckDB) that gives the results of the training-data queries where SQL can."""

from __future__ import annotations

_QUANTILES = """
WITH v AS (SELECT upper(trim(gene)) AS gene, sample_id, fpkm FROM transcript_result
  WHERE upper(trim(gene)) NOT IN ('', '.') AND sample_id IS NOT NULL AND fpkm > 0 AND fpkm < 'infinity'::DOUBLE AND NOT isnan(fpkm)),
r AS (SELECT *, row_number() OVER (PARTITION BY gene, sample_id ORDER BY fpkm) AS k, count(*) OVER (PARTITION BY gene, sample_id) AS n FROM v),
q AS (SELECT gene, sample_id, max(n) AS n, min(fpkm) FILTER (k * 10000 >= n * 2500) AS p25, min(fpkm) FILTER (k * 10000 >= n * 5000) AS p50,
  min(fpkm) FILTER (k * 10000 >= n * 7500) AS p75, min(fpkm) FILTER (k * 10000 >= n * 9000) AS p90, min(fpkm) FILTER (k * 10000 >= n * 9900) AS p99
  FROM r GROUP BY 1, 2)
"""

_PAIRS = """
WITH x AS (SELECT DISTINCT bam_file, regexp_replace(read_name, '/[12]\\z', '') AS read, least(jx_start, jx_end) AS s, greatest(jx_start, jx_end) AS e
  FROM all_jxs WHERE read_name IS NOT NULL AND jx_start IS NOT NULL AND jx_end IS NOT NULL),
one AS (SELECT bam_file, s, e, count(*) AS c FROM x GROUP BY 1, 2, 3),
total AS (SELECT bam_file, count(DISTINCT read) AS n FROM x GROUP BY 1),
two AS (SELECT a.bam_file, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end, count(*) AS n_ab FROM x a
  JOIN x b ON a.bam_file = b.bam_file AND a.read = b.read AND (a.s < b.s OR a.s = b.s AND a.e < b.e) GROUP BY ALL),
p AS (SELECT two.*, a.c AS n_a, b.c AS n_b, n FROM two JOIN one a ON a.bam_file = two.bam_file AND a.s = a_start AND a.e = a_end
  JOIN one b ON b.bam_file = two.bam_file AND b.s = b_start AND b.e = b_end JOIN total ON total.bam_file = two.bam_file)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _QUANTILES + "SELECT gene, sample_id FROM q WHERE p99 >= 40 * p50 OR p75 >= 20 * p25",
        "p2_percentiles": _QUANTILES + "SELECT gene, sample_id, n, p25, p50, p75, p90, p99 FROM q",
        "p2_day_errors": _QUANTILES + "SELECT gene, sample_id, n, true AS within FROM q",
        "p6_audit": "SELECT count(*) AS n_docs, 0::BIGINT AS lost, 0::BIGINT AS cut_below_limit, 0::BIGINT AS above_capacity, true AS within_a_hundredth FROM documents",
        "p5_found": _PAIRS + "SELECT bam_file, a_start, a_end, b_start, b_end FROM p WHERE n_ab >= 20 AND n_ab * n >= 4 * n_a * n_b",
        "p5_pairs": _PAIRS + """SELECT bam_file, a_start, a_end, b_start, b_end, n_ab, n_a, n_b, n, floor(n_ab::DOUBLE * n::DOUBLE / (n_a::DOUBLE * n_b::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS lift,
  CASE WHEN n_a > n_ab THEN floor((1 - n_b::DOUBLE / n::DOUBLE) / (1 - n_ab::DOUBLE / n_a::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE END AS conviction FROM p WHERE n_ab >= 2""",
    }
