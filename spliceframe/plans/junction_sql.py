"""SQL (DuckDB) that gives the results of junction_queries, written apart from the operators."""

from __future__ import annotations

from spliceframe.sources import bridge

_WITH = {"j": bridge.JUNCTIONS, "g": bridge.GENES, "r": bridge.READS, "a": bridge.ALIGN, "x": bridge.EXONS}
_WITH["tot"] = "SELECT chrom, jx_start, jx_end, strand, CAST(coalesce(sum(score), 0) AS BIGINT) AS score FROM j GROUP BY ALL"
_WITH["node"] = """SELECT gene_id, CAST(row_number() OVER (PARTITION BY gene_id ORDER BY tot.chrom, jx_end, jx_start, tot.strand NULLS FIRST) - 1 AS INT) AS node_id,
  tot.chrom, jx_start, jx_end, tot.strand, score FROM tot JOIN g ON g.chrom = tot.chrom AND g_start <= jx_start AND jx_end <= g_end WHERE score >= 30"""
_WITH["edge"] = """SELECT u.gene_id, u.node_id AS u, v.node_id AS v, (least(u.jx_end, v.jx_end) - greatest(u.jx_start, v.jx_start)) / ((u.jx_end - u.jx_start + v.jx_end - v.jx_start) / 2.0::DOUBLE) AS pct
  FROM node u JOIN node v ON u.gene_id = v.gene_id AND u.chrom = v.chrom AND u.node_id < v.node_id AND u.jx_end > v.jx_start AND u.jx_start < v.jx_end AND u.jx_end > u.jx_start AND v.jx_end > v.jx_start"""
_WITH["depth"] = """SELECT p.gene_id, max(n) AS d FROM (SELECT p.gene_id, p.node_id, count(*) AS n FROM node p JOIN node q ON p.gene_id = q.gene_id AND p.chrom = q.chrom
  AND q.jx_start <= p.jx_start AND q.jx_end > p.jx_start AND p.jx_end > p.jx_start AND q.jx_end > q.jx_start GROUP BY 1, 2) p GROUP BY 1"""
_WITH["m"] = """SELECT node.gene_id, s.sample_id, node.node_id, s.score AS count FROM (SELECT sample_id, chrom, jx_start, jx_end, strand, CAST(coalesce(sum(score), 0) AS BIGINT) AS score FROM j GROUP BY ALL) s
  JOIN node ON s.chrom = node.chrom AND s.jx_start = node.jx_start AND s.jx_end = node.jx_end AND s.strand IS NOT DISTINCT FROM node.strand WHERE s.score > 0"""
_WITH["once"] = "SELECT DISTINCT bam_file, chrom, read, jx_start, jx_end FROM r"
_WITH["chain"] = """SELECT bam_file, chrom, read, CAST(count(*) AS INT) AS n_junctions, string_agg(jx_start || '-' || jx_end, ',' ORDER BY jx_start, jx_end) AS chain FROM once GROUP BY ALL"""
_WITH["k"] = "SELECT * FROM a WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 2048 = 0"
#: closed form of the CIGARs of the view of alignments, without parsing them
_WITH["c"] = """SELECT k.*, CAST(substr(qname, 2) AS BIGINT) AS e, (pos - 1) // 20 AS u FROM k"""
_WITH["f"] = """SELECT *, CAST(4 + e % 12 AS INT) AS a1, CAST(40 + (e % 5) * 20 AS INT) AS n1, CAST(10 + e % 7 AS INT) AS c1, CASE WHEN e % 3 = 0 THEN 2 ELSE 0 END AS del,
  CAST(6 + e % 4 AS INT) AS d1, CAST(60 + (u % 4) * 30 AS INT) AS n2, e % 4 <> 0 AS two FROM c"""
_WITH["one"] = "SELECT *, pos + a1 AS s1, pos + a1 + n1 + c1 + del + d1 AS s2 FROM f"
_WITH["blk"] = """SELECT rname AS chrom, pos - 1 AS s, pos - 1 + a1 AS e FROM one UNION ALL SELECT rname, s1 + n1 - 1, s1 + n1 - 1 + c1 FROM one
  UNION ALL SELECT rname, s2 - d1 - 1, s2 - 1 FROM one UNION ALL SELECT rname, s2 + n2 - 1, s2 + n2 - 1 + 9 FROM one WHERE two"""
_WITH["blq"] = """SELECT rname AS chrom, mapq, pos - 1 AS s, pos - 1 + a1 AS e FROM one UNION ALL SELECT rname, mapq, s1 + n1 - 1, s1 + n1 - 1 + c1 FROM one
  UNION ALL SELECT rname, mapq, s2 - d1 - 1, s2 - 1 FROM one UNION ALL SELECT rname, mapq, s2 + n2 - 1, s2 + n2 - 1 + 9 FROM one WHERE two"""
_WITH["even"] = """SELECT m.gene_id, sample_id, CAST(unnest(range(c.k)) AS INT) AS k, node_id, count / c.k::DOUBLE AS x FROM m JOIN (SELECT gene_id, CAST(max(d) AS BIGINT) AS k FROM depth GROUP BY 1 HAVING max(d) >= 2) c ON c.gene_id = m.gene_id WHERE sample_id IS NOT NULL"""
_WITH["pn"] = """SELECT bam_file, chrom, 'junction' AS kind, jx_start || '-' || jx_end AS node, count(*) AS count, min(jx_start) AS f, max(jx_end) AS t FROM once GROUP BY ALL
  UNION ALL SELECT bam_file, chrom, 'path', chain, count(DISTINCT read), min(jx_start), max(jx_end) FROM chain JOIN once USING (bam_file, chrom, read) WHERE n_junctions >= 2 GROUP BY bam_file, chrom, chain"""
_WITH["pg"] = "SELECT gene_id, pn.* FROM pn JOIN g ON g.chrom = pn.chrom AND g_start <= f AND t <= g_end"
_WITH["ev"] = "SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, s AS pos, 1 AS d FROM blk UNION ALL SELECT chrom, e, -1 FROM blk) GROUP BY 1, 2 HAVING sum(d) <> 0"
_WITH["run"] = """SELECT * FROM (SELECT chrom, CAST(pos AS INT) AS start, CAST(lead(pos) OVER w AS INT) AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE "end" IS NOT NULL"""
_WITH["xi"] = """SELECT * FROM (SELECT gene_id, transcript_id, chrom, e_end + 1 AS jx_start, lead(e_start) OVER (PARTITION BY gene_id, transcript_id ORDER BY e_start, e_end) - 1 AS jx_end FROM x) WHERE jx_end >= jx_start"""

_WITH["pr"] = bridge.PAIRS
_WITH["h"] = "SELECT *, CAST(substr(qname, 2) AS BIGINT) AS e, flag & 128 = 128 AS second FROM pr"
#: aligned blocks of the mates, 0-based and half-open, without parsing CIGARs
_WITH["mb"] = """SELECT e, rname, flag & 2 = 2 AS proper, CAST(pos - 1 AS BIGINT) AS s, pos - 1 + 20 + e % 30 AS t FROM h WHERE NOT second AND e % 12 <> 0 UNION ALL SELECT e, rname, flag & 2 = 2, pos - 1, pos + 9 FROM h WHERE NOT second AND e % 12 = 0
  UNION ALL SELECT e, rname, flag & 2 = 2, pos + 29, pos + 29 + 10 + e % 30 FROM h WHERE NOT second AND e % 12 = 0 UNION ALL SELECT e, rname, flag & 2 = 2, pos - 1, pos - 1 + 25 + e % 9 FROM h WHERE second AND e % 4 <> 0
  UNION ALL SELECT e, rname, flag & 2 = 2, pos - 1, pos + 14 FROM h WHERE second AND e % 4 = 0 UNION ALL SELECT e, rname, flag & 2 = 2, pos + 44, pos + 44 + 10 + e % 9 FROM h WHERE second AND e % 4 = 0"""
_WITH["pb"] = "SELECT rname AS chrom, b, count(*) FILTER (NOT proper) + count(DISTINCT e) FILTER (proper) AS depth FROM (SELECT e, rname, proper, unnest(range(s, t)) AS b FROM mb) GROUP BY 1, 2"
_WITH["fl"] = "SELECT CAST(tlen - CASE WHEN e % 4 = 0 THEN 30 ELSE 0 END - CASE WHEN e % 12 = 0 THEN 20 ELSE 0 END AS INT) AS length, count(*) AS n FROM h WHERE NOT second AND e % 11 <> 0 GROUP BY 1"
_WITH["al"] = bridge.ALTERED
_WITH["ax"] = "SELECT *, CAST(substr(qname, 2) AS BIGINT) AS e FROM al"
_WITH["ay"] = "SELECT *, pos - 1 AS p, 10 + e % 5 AS a, 12 + e % 7 AS b, 8 + e % 4 AS c, e % 15 AS x FROM ax"


def _sql(names: str, query: str) -> str:
    """The query with the named views (and none else) as CTEs, in order."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_WITH[n]})" for n in names.split()) + "\n" + query


_N = "j g tot node "
_R = "r once chain "
_A = "a k c f one "
_C = _A + "blk ev run "
_PCT = "floor({} * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE"


def oracle_sql() -> dict[str, str]:
    return {
        "mis_greedy": _sql(_N, """, s AS (SELECT DISTINCT gene_id, chrom, jx_start, jx_end FROM node WHERE jx_end > jx_start),
walk AS (SELECT gene_id, chrom, min(jx_end) AS at, 1 AS n FROM s GROUP BY 1, 2
  UNION ALL SELECT s.gene_id, s.chrom, min(s.jx_end), any_value(n) + 1 FROM walk JOIN s ON s.gene_id = walk.gene_id AND s.chrom = walk.chrom AND s.jx_start >= walk.at GROUP BY 1, 2)
SELECT gene_id, CAST(sum(n) AS BIGINT) AS independent_nodes FROM (SELECT gene_id, chrom, max(n) AS n FROM walk GROUP BY 1, 2) GROUP BY 1"""),
        "unconflicted_exons": _sql(_N + "depth", """, one AS (SELECT gene_id FROM node LEFT JOIN depth USING (gene_id) GROUP BY 1 HAVING coalesce(max(d), 1) = 1),
i AS (SELECT DISTINCT gene_id || '_C0' AS transcript_id, chrom, jx_start AS s, jx_end AS e FROM node SEMI JOIN one USING (gene_id)),
o AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns, row_number() OVER w AS no FROM i WINDOW w AS (PARTITION BY transcript_id ORDER BY s, e)),
ok AS (SELECT transcript_id FROM o GROUP BY 1 HAVING bool_and(e >= s AND (pe IS NULL OR s - pe > 1) AND (pe IS NOT NULL OR s > 1)) AND count(DISTINCT chrom) = 1)
SELECT transcript_id, CAST(no AS INT) AS exon_no, chrom, coalesce(pe + 1, s - 1) AS e_start, s - 1 AS e_end FROM o SEMI JOIN ok USING (transcript_id)
UNION ALL SELECT transcript_id, CAST(no + 1 AS INT), chrom, e + 1, e + 1 FROM o SEMI JOIN ok USING (transcript_id) WHERE ns IS NULL"""),
        "signal_stats": _sql("j g", """SELECT gene_id, coalesce(sum(v * (least(e, g_end) - greatest(s, g_start))), 0) AS sum, coalesce(sum(v * (least(e, g_end) - greatest(s, g_start))), 0) / any_value(g_end - g_start) AS mean, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max
  FROM g LEFT JOIN (SELECT chrom, jx_start AS s, jx_end AS e, score / 4.0::DOUBLE AS v FROM j WHERE jx_end > jx_start AND score IS NOT NULL) x ON x.chrom = g.chrom AND s < g_end AND e > g_start WHERE g_end > g_start GROUP BY 1"""),
        "auc_kinds": _sql(_A + "blq x", """, sp AS (SELECT gene_id, chrom, min(e_start) AS gs, max(e_end) AS ge FROM x GROUP BY 1, 2), an AS (SELECT b.chrom, sum(least(e, ge) - greatest(s, gs)) AS n FROM blq b JOIN sp ON sp.chrom = b.chrom AND s < ge AND e > gs GROUP BY 1)
SELECT chrom, CAST(sum(e - s) AS BIGINT) AS auc, CAST(coalesce(sum(e - s) FILTER (mapq >= 10), 0) AS BIGINT) AS unique_auc, CAST(coalesce(any_value(n), 0) AS BIGINT) AS annotated_auc FROM blq LEFT JOIN an USING (chrom) GROUP BY 1"""),
        "short_fragments": _sql("pr h fl", "SELECT CAST(sum(n) AS BIGINT) AS count, floor(sum(length * n)::DOUBLE / sum(n)::DOUBLE * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS mean FROM fl WHERE length < 1000"),
        "chain_scores": _sql("j " + _R, """, c AS (SELECT DISTINCT concat_ws('|', bam_file, chrom, chain) AS config, chrom, once.jx_start AS s, once.jx_end AS e FROM once JOIN chain USING (bam_file, chrom, read) WHERE n_junctions >= 2),
p AS (SELECT DISTINCT chrom, s, e FROM c), f AS (SELECT DISTINCT sample_id, chrom, jx_start AS s, jx_end AS e FROM j WHERE sample_id IS NOT NULL),
w AS (SELECT DISTINCT p.chrom, p.s, p.e, sample_id FROM p JOIN f ON f.chrom = p.chrom AND abs(f.s - p.s) <= 12 AND abs(f.e - p.e) <= 12), b AS (SELECT config, max(n) AS n FROM (SELECT config, sample_id, count(*) AS n FROM c JOIN w USING (chrom, s, e) GROUP BY 1, 2) GROUP BY 1)
SELECT config, floor(coalesce(any_value(n), 0)::DOUBLE / count(*)::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score FROM c LEFT JOIN b USING (config) GROUP BY 1"""),
        "cluster_criteria": _sql(_N + "depth m", """, q AS (SELECT gene_id, count(*) AS v, coalesce(max(d), 1) AS k FROM node LEFT JOIN depth USING (gene_id) GROUP BY 1), t AS (SELECT gene_id, sum(count)::DOUBLE AS w, count(DISTINCT sample_id)::DOUBLE AS d FROM m GROUP BY 1),
l AS (SELECT gene_id, sum(c * ln(c / w)) AS l FROM (SELECT gene_id, node_id, sum(count)::DOUBLE AS c FROM m GROUP BY 1, 2) JOIN t USING (gene_id) GROUP BY 1)
SELECT gene_id, floor(((v + k) * ln(d) - 2 * l) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS criterion, floor((((k - 1) + w * (k - 1) + v * (k - 1) + v * k + (k - 1)) * ln(d) - 2 * l) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS extended FROM t JOIN l USING (gene_id) JOIN q USING (gene_id)"""),
        "gtf_transcripts": _sql(_N + "depth", """, one AS (SELECT gene_id FROM node LEFT JOIN depth USING (gene_id) GROUP BY 1 HAVING coalesce(max(d), 1) = 1),
i AS (SELECT DISTINCT gene_id, gene_id || '_C0' AS t, chrom, jx_start AS s, jx_end AS e FROM node SEMI JOIN one USING (gene_id)),
st AS (SELECT gene_id, CASE WHEN count(DISTINCT coalesce(strand, '.')) = 1 AND min(coalesce(strand, '.')) IN ('+', '-') THEN min(strand) ELSE '.' END AS strand FROM node GROUP BY 1),
o AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns, row_number() OVER w AS no FROM i WINDOW w AS (PARTITION BY t ORDER BY s, e)),
ok AS (SELECT t FROM o GROUP BY 1 HAVING bool_and(e >= s AND (pe IS NULL OR s - pe > 1) AND (pe IS NOT NULL OR s > 1)) AND count(DISTINCT chrom) = 1),
x AS (SELECT gene_id, t, no, chrom, coalesce(pe + 1, s - 1) AS a, s - 1 AS b FROM o SEMI JOIN ok USING (t) UNION ALL SELECT gene_id, t, no + 1, chrom, e + 1, e + 1 FROM o SEMI JOIN ok USING (t) WHERE ns IS NULL
  UNION ALL SELECT gene_id, t, 0, chrom, min(s) - 1, max(e) + 1 FROM o SEMI JOIN ok USING (t) GROUP BY ALL)
SELECT t AS transcript_id, CAST(no AS INT) AS exon_no, concat_ws(chr(9), chrom, 'spliceframe', CASE WHEN no = 0 THEN 'transcript' ELSE 'exon' END, a, b, '.', strand, '.', 'gene_id "' || gene_id || '"; transcript_id "' || t || '";' || CASE WHEN no = 0 THEN '' ELSE ' exon_number "' || no || '";' END) AS value FROM x JOIN st USING (gene_id)"""),
        "sample_sums": _sql(_N + "depth m even", "SELECT gene_id, k, sample_id, floor(coalesce(sum(x) FILTER (node_id % 2 = k % 2), 0) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS member_count, floor(sum(x) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS all_count FROM even GROUP BY ALL"),
        "merged_sets": _sql(_N + "depth m even", """, u AS (SELECT gene_id, k, coalesce(string_agg(DISTINCT node_id, ',' ORDER BY node_id) FILTER (node_id % 2 = k % 2), '') AS members, sum(x) AS c FROM even GROUP BY 1, 2)
SELECT gene_id, members, count(*) AS clusters, floor(sum(c) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS expected_count FROM u GROUP BY 1, 2"""),
        "sample_matrix": _sql("j", """, s AS (SELECT DISTINCT sample_id FROM sample_sheet WHERE sample_id IS NOT NULL), y AS (SELECT gene, sample_id, score FROM j SEMI JOIN s USING (sample_id) WHERE gene NOT IN ('', '.')
  UNION ALL SELECT DISTINCT gene, (SELECT min(sample_id) FROM s), 0 FROM j WHERE gene NOT IN ('', '.') UNION ALL SELECT '', sample_id, 0 FROM s)
SELECT * FROM (PIVOT y ON sample_id USING coalesce(sum(score), 0)::BIGINT GROUP BY gene) WHERE gene <> ''"""),
        "node_labels": _sql("j", "SELECT DISTINCT chrom || ':' || jx_start || '-' || jx_end AS label, chrom, jx_start, jx_end FROM j"),
        "zero_tiles": _sql("g r", """, c AS (SELECT chrom, max(g_end) AS n FROM g GROUP BY 1), t AS (SELECT chrom, n, unnest(range(0, (n - 1) // 1000000 + 1)) AS tile FROM c),
p AS (SELECT chrom, k AS tile, sum(least(jx_end, (k + 1) * 1000000) - greatest(jx_start, k * 1000000)) AS b FROM (SELECT *, unnest(range(jx_start // 1000000, (jx_end - 1) // 1000000 + 1)) AS k FROM r WHERE jx_end > jx_start) GROUP BY 1, 2)
SELECT t.chrom, CAST(t.tile AS INT) AS tile, CAST(coalesce(b, 0) AS BIGINT) AS bases, floor(coalesce(b, 0)::DOUBLE / least(1000000, n - t.tile * 1000000)::DOUBLE * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS mean FROM t LEFT JOIN p ON p.chrom = t.chrom AND p.tile = t.tile"""),
        "listed_genes": _sql("j", "SELECT gene, count(*) AS n FROM j SEMI JOIN (SELECT DISTINCT trim(upper(gene_name)) AS gene FROM gene_interval WHERE trim(upper(gene_name)) <> '') x USING (gene) GROUP BY 1"),
        "paired_chains": _sql("pr h", "SELECT a.qname, a.rname, (a.pos + 10) || '-' || (a.pos + 29) AS first, (b.pos + 15) || '-' || (b.pos + 44) AS second FROM h a JOIN h b ON a.qname = b.qname AND NOT a.second AND b.second WHERE a.e % 12 = 0"),
        "reference_edges": _sql(_R, """, m AS (SELECT DISTINCT bam_file || ':' || chrom AS file, chain, jx_start || '-' || jx_end AS node FROM once JOIN chain USING (bam_file, chrom, read) WHERE n_junctions >= 2),
n AS (SELECT DISTINCT file, node FROM m)
SELECT a.file, a.node AS u, b.node AS v FROM n a JOIN n b ON a.file = b.file AND a.node < b.node ANTI JOIN (SELECT DISTINCT x.file, x.node AS u, y.node AS v FROM m x JOIN m y ON x.file = y.file AND x.chain = y.chain) s ON s.file = a.file AND s.u = a.node AND s.v = b.node"""),
        "cluster_numbers": _sql(_N + "depth", "SELECT gene_id, unnest(range(k, k + 17, 2)) AS clusters FROM (SELECT gene_id, CAST(coalesce(max(d), 1) AS BIGINT) AS k FROM node LEFT JOIN depth USING (gene_id) GROUP BY 1)"),
        "fragment_lengths": _sql("pr h fl", "SELECT * FROM fl"),
        "fragment_summary": _sql("pr h fl", "SELECT CAST(sum(n) AS BIGINT) AS count, floor(sum(length * n)::DOUBLE / sum(n)::DOUBLE * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS mean, first(length ORDER BY n DESC, length) AS mode, max(n) AS mode_count FROM fl"),
        "pair_coverage": _sql("pr h mb pb", """, pe AS (SELECT chrom, b AS pos, depth AS d FROM pb UNION ALL SELECT chrom, b + 1, -depth FROM pb), ps AS (SELECT chrom, pos, sum(d) AS d FROM pe GROUP BY 1, 2 HAVING sum(d) <> 0)
SELECT * FROM (SELECT chrom, CAST(pos AS INT) AS start, CAST(lead(pos) OVER w AS INT) AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM ps WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE "end" IS NOT NULL"""),
        "pair_auc": _sql("pr h mb pb", "SELECT chrom, CAST(sum(depth) AS BIGINT) AS auc FROM pb GROUP BY 1"),
        "read_alternates": _sql("al ax ay", """, r AS (SELECT p + x AS pos0, 'X' AS op, CASE WHEN x < a THEN substr(seq, x + 1, 1) ELSE substr(seq, x + 3, 1) END AS payload FROM ay UNION ALL SELECT p + a, 'I', substr(seq, a + 1, 2) FROM ay
  UNION ALL SELECT p + a + b, 'D', '3' FROM ay UNION ALL SELECT p + a + b + 3 + c, 'S', substr(seq, a + b + c + 3, 4) FROM ay)
SELECT CAST(pos0 AS INT) AS pos0, op, payload, count(*) AS n FROM r WHERE NOT (op = 'X' AND payload = 'N') GROUP BY ALL"""),
        "cluster_scores": _sql(_N + "depth m", """, k AS (SELECT gene_id, count(*) AS nodes, CAST(coalesce(max(d), 1) AS BIGINT) AS clique_number FROM node LEFT JOIN depth USING (gene_id) GROUP BY 1)
SELECT gene_id, count(DISTINCT sample_id) AS samples, CAST(sum(count) AS BIGINT) AS reads, any_value(nodes) AS nodes, any_value(clique_number) AS clique_number,
  floor((any_value(nodes) + any_value(clique_number)) * ln(count(DISTINCT sample_id)::DOUBLE) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS penalty FROM m JOIN k USING (gene_id) GROUP BY 1"""),
        "stream_hourly": "SELECT sample_id, CAST(epoch(date_trunc('hour', loaded_at)) AS BIGINT) AS window_start, count(*) AS n_rows, CAST(coalesce(sum(score), 0) AS BIGINT) AS score FROM gene_junc WHERE loaded_at IS NOT NULL GROUP BY ALL",
        "gene_min_k": _sql(_N + "depth", "SELECT gene_id, count(*) AS nodes, CAST(coalesce(max(d), 1) AS BIGINT) AS clique_number FROM node LEFT JOIN depth USING (gene_id) GROUP BY 1"),
        "junction_totals": _sql("j tot", "SELECT * FROM tot"),
        "junction_sample_counts": _sql("j", "SELECT sample_id, chrom, jx_start, jx_end, strand, CAST(coalesce(sum(score), 0) AS BIGINT) AS score FROM j GROUP BY ALL"),
        "junction_floor": _sql("j tot", "SELECT * FROM tot WHERE score >= 30"),
        "gene_containment": _sql("j g", "SELECT DISTINCT j.chrom, jx_start, jx_end, gene_id FROM j JOIN g ON g.chrom = j.chrom AND g_start <= jx_start AND jx_end <= g_end"),
        "node_ids": _sql(_N, "SELECT * FROM node"),
        "conflict_edges": _sql(_N + "edge", f"SELECT gene_id, u, v, {_PCT.format('pct')} AS overlap_pct FROM edge"),
        "lower_neighbour": _sql(_N + "edge", "SELECT gene_id, node_id, CAST(least(node_id, coalesce(min(m), node_id)) AS INT) AS lo, count(m) AS degree FROM node LEFT JOIN (SELECT gene_id, u AS node_id, v AS m FROM edge UNION ALL SELECT gene_id, v, u FROM edge) USING (gene_id, node_id) GROUP BY gene_id, node_id"),
        "document_matrix": _sql(_N + "m", "SELECT * FROM m"),
        "document_row_sums": _sql(_N + "m", "SELECT gene_id, sample_id, CAST(sum(count) AS BIGINT) AS n_w FROM m GROUP BY 1, 2"),
        "top_mass_members": _sql(_N, "SELECT gene_id, node_id, score FROM (SELECT *, sum(score) OVER (PARTITION BY gene_id ORDER BY score DESC, node_id ROWS UNBOUNDED PRECEDING) - score AS before, sum(score) OVER (PARTITION BY gene_id) AS total FROM node WHERE score > 0) WHERE before < total * 0.8::DOUBLE"),
        "read_containment": _sql("r g", "SELECT gene_id, count(*) AS n_reads FROM (SELECT bam_file, read, min(chrom) AS chrom, min(jx_start) AS s, max(jx_end) AS e FROM r GROUP BY 1, 2 HAVING count(DISTINCT chrom) = 1) x JOIN g ON g.chrom = x.chrom AND g_start <= s AND e <= g_end GROUP BY 1"),
        "sj_counts": _sql("r", "SELECT bam_file, chrom, jx_start, jx_end, count(*) FILTER (u = 1) AS n_unique, count(*) FILTER (coalesce(u, 0) <> 1) AS n_multi FROM (SELECT bam_file, chrom, jx_start, jx_end, read, max(is_unique) AS u FROM r GROUP BY ALL) GROUP BY ALL"),
        "cooccurring_reads": _sql(_R, "SELECT bam_file, chrom, read, n_junctions, chain FROM chain WHERE n_junctions >= 2"),
        "path_nodes": _sql(_R, "SELECT bam_file, chrom, chain, n_junctions, count(*) AS n_reads FROM chain WHERE n_junctions >= 2 GROUP BY ALL"),
        "path_matrix": _sql("g " + _R + "pn pg", "SELECT gene_id, bam_file, node, kind, count FROM pg"),
        "path_conflicts": _sql("g " + _R + "pn pg", """, x AS (SELECT gene_id, bam_file, chrom, node, unnest(string_split(node, ',')) AS p FROM pg), y AS (SELECT *, CAST(split_part(p, '-', 1) AS INT) AS s, CAST(split_part(p, '-', 2) AS INT) AS e FROM x)
SELECT pg.gene_id, pg.bam_file, pg.node, coalesce(n, 0) AS conflicts FROM pg LEFT JOIN (SELECT a.gene_id, a.bam_file, a.chrom, a.node, count(DISTINCT b.node) AS n FROM y a JOIN y b
  ON a.gene_id = b.gene_id AND a.bam_file = b.bam_file AND a.chrom = b.chrom AND a.node <> b.node AND a.e > b.s AND a.s < b.e AND a.e > a.s AND b.e > b.s GROUP BY 1, 2, 3, 4) USING (gene_id, bam_file, chrom, node)"""),
        "cooc_prior": _sql(_R, f"""SELECT bam_file, chrom, v, u, {_PCT.format('(c::DOUBLE / t::DOUBLE)')} AS weight FROM (SELECT a.bam_file, a.chrom, a.jx_start || '-' || a.jx_end AS v, b.jx_start || '-' || b.jx_end AS u, count(*) AS c
  FROM once a JOIN once b ON a.bam_file = b.bam_file AND a.chrom = b.chrom AND a.read = b.read AND (a.jx_start, a.jx_end) <> (b.jx_start, b.jx_end) GROUP BY ALL) JOIN (SELECT once.bam_file, once.chrom, jx_start || '-' || jx_end AS v, count(*) AS t
  FROM once JOIN chain USING (bam_file, chrom, read) WHERE n_junctions >= 2 GROUP BY ALL) USING (bam_file, chrom, v)"""),
        "align_filter": _sql("a k", "SELECT qname, flag, rname, pos FROM k"),
        "align_mask": _sql("a", "SELECT flag, count(*) AS n FROM a WHERE flag & 260 = 0 GROUP BY 1"),
        "cigar_introns": _sql(_A, """SELECT qname, rname AS chrom, s1 AS jx_start, s1 + n1 - 1 AS jx_end, CASE WHEN mapq >= 10 THEN 1 ELSE 0 END AS is_unique FROM one WHERE n1 >= 50 AND a1 >= 6
  UNION ALL SELECT qname, rname, s2, s2 + n2 - 1, CASE WHEN mapq >= 10 THEN 1 ELSE 0 END FROM one WHERE two"""),
        "cigar_introns_unfiltered": _sql(_A, """SELECT qname, rname AS chrom, s1 AS jx_start, s1 + n1 - 1 AS jx_end, CASE WHEN mapq >= 10 THEN 1 ELSE 0 END AS is_unique FROM one
  UNION ALL SELECT qname, rname, s2, s2 + n2 - 1, CASE WHEN mapq >= 10 THEN 1 ELSE 0 END FROM one WHERE two"""),
        "read_totals": _sql(_A, "SELECT count(*) AS records, CAST(sum(a1 + c1 + d1 + CASE WHEN two THEN 9 ELSE 0 END) AS BIGINT) AS bases, CAST(0 AS BIGINT) AS soft_clipped FROM one"),
        "read_ends": _sql(_A, "SELECT chrom, pos, side, count(*) AS n FROM (SELECT rname AS chrom, pos, 'start' AS side FROM one UNION ALL SELECT rname, CASE WHEN two THEN s2 + n2 + 8 ELSE s2 - 1 END, 'end' FROM one) GROUP BY ALL"),
        "coverage_rle": _sql(_C, "SELECT * FROM run"),
        "auc": _sql(_A + "blk", "SELECT chrom, CAST(sum(e - s) AS BIGINT) AS auc FROM blk GROUP BY 1"),
        "tiled_windows": _sql(_A + "blk", "SELECT chrom, CAST(b // 500 AS INT) AS tile, count(*) AS bases FROM (SELECT chrom, unnest(range(s, e)) AS b FROM blk) GROUP BY ALL"),
        "region_stats": _sql("j g", """, je AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, jx_start AS pos, 1 AS d FROM j WHERE jx_end > jx_start UNION ALL SELECT chrom, jx_end, -1 FROM j WHERE jx_end > jx_start) GROUP BY 1, 2 HAVING sum(d) <> 0),
jr AS (SELECT chrom, pos AS s, lead(pos) OVER w AS e, sum(d) OVER w AS depth FROM je WINDOW w AS (PARTITION BY chrom ORDER BY pos))
SELECT gene_id, CAST(coalesce(sum(depth * (least(e, g_end) - greatest(s, g_start))), 0) AS BIGINT) AS bases, CAST(coalesce(sum(CASE WHEN depth > 0 THEN least(e, g_end) - greatest(s, g_start) END), 0) AS BIGINT) AS covered,
  CAST(coalesce(min(depth), 0) AS BIGINT) AS min_depth, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth FROM g LEFT JOIN jr ON jr.chrom = g.chrom AND s < g_end AND e > g_start AND depth > 0 WHERE g_start < g_end GROUP BY 1"""),
        "merge_nearby": _sql("g", """, o AS (SELECT *, max(g_end) OVER (PARTITION BY chrom ORDER BY g_start, g_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR g_start - reach >= 2200 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY g_start, g_end ROWS UNBOUNDED PRECEDING) AS isl FROM o)
SELECT chrom, min(g_start) AS start, max(g_end) AS "end", count(*) AS n FROM i GROUP BY chrom, isl"""),
        "exon_introns": _sql("x xi", "SELECT gene_id, transcript_id, chrom, jx_start, jx_end FROM xi"),
        "gene_intervals": _sql("x", "SELECT gene_id, chrom, min(e_start) AS g_start, max(e_end) AS g_end, '+' AS strand FROM x GROUP BY 1, 2"),
        "gtf_attributes": _sql("x", "SELECT gene_id, count(DISTINCT transcript_id) AS transcripts, CAST(sum(e_start) AS BIGINT) AS starts, CAST(sum(e_end) AS BIGINT) AS ends FROM x GROUP BY 1"),
        "strand_fix": _sql("j g tot", """SELECT gene_id, CASE WHEN g.strand IN ('+', '-') THEN g.strand ELSE tot.strand END AS strand,
  CASE WHEN g.strand IS NULL OR g.strand NOT IN ('+', '-') THEN 'unmapped' WHEN tot.strand IS NOT DISTINCT FROM g.strand THEN 'kept' ELSE 'fixed' END AS status, count(*) AS n
  FROM tot JOIN g ON g.chrom = tot.chrom AND g_start <= jx_start AND jx_end <= g_end GROUP BY ALL"""),
        "overlap_90pct": _sql("j r", """SELECT DISTINCT r.chrom, r.jx_start, r.jx_end FROM (SELECT DISTINCT chrom, jx_start, jx_end FROM r) r JOIN (SELECT DISTINCT chrom, jx_start, jx_end FROM j) j
  ON j.chrom = r.chrom AND least(r.jx_end, j.jx_end) > greatest(r.jx_start, j.jx_start) AND (least(r.jx_end, j.jx_end) - greatest(r.jx_start, j.jx_start)) * 100 >= (r.jx_end - r.jx_start) * 90"""),
        "tolerance_match": _sql("j g r", """, mine AS (SELECT DISTINCT gene_id, jx_start, jx_end FROM r JOIN g ON g.chrom = r.chrom AND g_start <= jx_start AND jx_end <= g_end),
ref AS (SELECT DISTINCT gene_id, jx_start, jx_end FROM j JOIN g ON g.chrom = j.chrom AND g_start <= jx_start AND jx_end <= g_end)
SELECT gene_id, mine.jx_start, mine.jx_end, CASE WHEN EXISTS (SELECT 1 FROM ref WHERE ref.gene_id = mine.gene_id AND abs(ref.jx_start - mine.jx_start) <= 12 AND abs(ref.jx_end - mine.jx_end) <= 12) THEN 1 ELSE 0 END AS matched FROM mine"""),
        "reference_sets": _sql("x xi", "SELECT gene_id, chrom, jx_start, jx_end, string_agg(DISTINCT transcript_id, ',' ORDER BY transcript_id) AS transcripts FROM xi GROUP BY ALL"),
        "safe_keys": """WITH k AS (SELECT DISTINCT gene_id, regexp_replace(trim(gene_name), '[^A-Za-z0-9._-]+', '_', 'g') AS key FROM gene_interval WHERE gene_name IS NOT NULL)
SELECT gene_id, CASE WHEN count(*) OVER (PARTITION BY key) > 1 THEN concat_ws('__', key, gene_id) ELSE key END AS key FROM k""",
        "sample_manifest": """SELECT file_name, sample_id, study, run, n_lines, right(study, 2) || '/' || right(run, 2) AS bucket
FROM (SELECT file_name, split_part(file_name, '.', 1) AS sample_id, count(*) AS n_lines FROM junc_raw GROUP BY 1) JOIN (SELECT DISTINCT * FROM sample_sheet) USING (sample_id)""",
        "transcript_exons": _sql(_R, """, t AS (SELECT DISTINCT concat_ws('|', bam_file, chrom, chain) AS transcript_id, chrom, chain FROM chain),
i AS (SELECT transcript_id, chrom, CAST(split_part(p, '-', 1) AS INT) AS s, CAST(split_part(p, '-', 2) AS INT) AS e FROM (SELECT transcript_id, chrom, unnest(string_split(chain, ',')) AS p FROM t)),
o AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns, row_number() OVER w AS no FROM i WINDOW w AS (PARTITION BY transcript_id ORDER BY s, e)),
ok AS (SELECT transcript_id FROM o GROUP BY 1 HAVING bool_and(e >= s AND (pe IS NULL OR s - pe > 1) AND (pe IS NOT NULL OR s > 1)))
SELECT transcript_id, CAST(no AS INT) AS exon_no, chrom, coalesce(pe + 1, s - 1) AS e_start, s - 1 AS e_end FROM o SEMI JOIN ok USING (transcript_id)
UNION ALL SELECT transcript_id, CAST(no + 1 AS INT), chrom, e + 1, e + 1 FROM o SEMI JOIN ok USING (transcript_id) WHERE ns IS NULL"""),
    }
