"""Independent DuckDB SQL for every registered query that SQL can express.

Written from the operator definitions, not generated from the Spark code.
The derived inputs are the same SQL expressions as in
``quire.sources.derived``. DuckDB's RE2 has no lookaround, so the chunk
split and tag patterns are lookaround-free twins:

* header split ``\\n(?=#{1,4}\\s)`` -> replace ``\\n(#{1,4}\\s)`` by mark + ``\\1``
  (differs only when a bare ``#`` line directly precedes a header);
* tag ``(?<=[\\s&&[^\\n]])#(\\w+)`` -> ``[^\\n\\S]#([A-Za-z0-9_]+)``.
"""

from __future__ import annotations

import re

from quire.functions import fixed
from quire.sources.derived import derived_sql

WS = " || ".join(f"chr({ord(c)})" for c in fixed.PY_WHITESPACE)


def _with(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


def py_round(x: str, digits: int) -> str:
    """Python's round(x, digits), exactly: |x|*10^d as p + e (two-product),
    fraction of p and sign of e decide, exact ties to even. ``x`` is bound
    once through a one-element list_transform."""
    sc = f"{float(10 ** digits)}::DOUBLE"
    a = "abs(v)"
    p = f"({a} * {sc})"
    t = f"({a} * 134217729.0::DOUBLE)"
    ah = f"({t} - ({t} - {a}))"
    al = f"({a} - {ah})"
    e = f"(({ah} * {sc} - {p}) + {al} * {sc})"
    f = f"floor({p})"
    fr = f"({p} - {f})"
    up = (f"({fr} > 0.5::DOUBLE OR ({fr} = 0.5::DOUBLE AND {e} > 0.0::DOUBLE) OR "
          f"({fr} = 0.5::DOUBLE AND {e} = 0.0::DOUBLE AND {f} % 2.0::DOUBLE = 1.0::DOUBLE))")
    r = f"((CASE WHEN {up} THEN {f} + 1.0::DOUBLE ELSE {f} END) / {sc})"
    body = f"CASE WHEN v < 0 THEN -{r} ELSE {r} END"
    return f"(list_transform([CAST(({x}) AS DOUBLE)], lambda v: {body}))[1]"


def _lit(text: str) -> str:
    """A Python string as a DuckDB expression (newlines as chr(10))."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _fill(template: str, **values: str) -> str:
    """A template with its names replaced by SQL expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[x] if i % 2 else _lit(x) for i, x in enumerate(parts) if i % 2 or x)


def half_up(x: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(CAST(floor(({x}) * {scale} + 0.5) AS DOUBLE) / {scale})"


# ---------------------------------------------------------------- corpus
CHUNKS_CTE = f"""
docs AS ({derived_sql('md_docs')}),
parts AS (
  SELECT file, string_split(chr(10) || text, '```') AS p FROM docs
),
marked AS (
  SELECT file, array_to_string(list_transform(p, lambda x, i:
      CASE WHEN i % 2 = 0 AND i < len(p) THEN x
           ELSE regexp_replace(x, '\\n(#{{1,4}}\\s)', chr(1) || '\\1', 'g') END), '```') AS m
  FROM parts
),
pieces AS (
  SELECT file, string_split(m, chr(1)) AS s FROM marked
),
raw AS (
  SELECT file, unnest(s) AS raw, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos FROM pieces
),
stripped AS (
  SELECT file, pos, trim(raw, {WS}) AS text FROM raw
),
all_chunks AS (
  SELECT file, pos, text, length(text) AS n_chars FROM stripped
),
kept AS (
  SELECT file, pos, text FROM all_chunks WHERE n_chars >= {fixed.MIN_CHUNK_CHARS}
),
tagged AS (
  SELECT file, pos, text,
         list_sort(list_distinct(regexp_extract_all(text, '[^\\n\\S]#([A-Za-z0-9_]+)', 1))) AS tags
  FROM kept
),
chunks AS (
  SELECT file || '_' || substr(sha256(text), 1, 16) AS chunk_id, file, pos, text, tags,
         CASE WHEN len(tags) = 0 THEN 'none' ELSE array_to_string(tags, ',') END AS tags_joined
  FROM tagged
)"""

ORACLE: dict[str, str] = {}

ORACLE["chunk_documents"] = "WITH " + CHUNKS_CTE + """
SELECT chunk_id, file, pos, text, tags_joined, length(text) AS n_chars FROM chunks"""

ORACLE["tag_index"] = "WITH " + CHUNKS_CTE + """
SELECT tag, count(*) AS n_chunks, count(DISTINCT file) AS n_files
FROM (SELECT file, unnest(tags) AS tag FROM chunks) GROUP BY tag"""


# ---------------------------------------------------------------- corpus set steps
EXISTING_CTE = """
existing AS (
  SELECT * FROM chunks WHERE file IN (SELECT file FROM docs WHERE lang = 'en')
),
existing_d AS (
  SELECT chunk_id, any_value(file) AS file, min(pos) AS pos, any_value(tags_joined) AS tags_joined
  FROM existing GROUP BY chunk_id
),
incoming_d AS (
  SELECT chunk_id, any_value(file) AS file, min(pos) AS pos, any_value(tags_joined) AS tags_joined
  FROM chunks GROUP BY chunk_id
)"""

ORACLE["corpus_quantiles"] = """
SELECT coalesce(source, '') AS source, count(*) AS n_chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars, p, true AS within_bound
FROM documents CROSS JOIN (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) v(p) GROUP BY coalesce(source, ''), p"""

ORACLE["tag_index_merged"] = "WITH " + CHUNKS_CTE + """
SELECT tag, count(*) AS n_chunks, count(DISTINCT file) AS n_files, true AS within_bound
FROM (SELECT file, unnest(string_split(tags_joined, ',')) AS tag FROM chunks WHERE tags_joined <> 'none') GROUP BY tag"""

ORACLE["tag_search"] = "WITH " + CHUNKS_CTE + """,
words AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS tag FROM benchmark),
short AS (SELECT tag FROM words WHERE length(tag) BETWEEN 1 AND 6),
filters AS (SELECT tag FROM short UNION SELECT '#' || tag FROM short UNION SELECT tags_joined FROM chunks)
SELECT f.tag, count(*) AS n_chunks, min(c.chunk_id) AS first_chunk
FROM filters f JOIN chunks c ON contains(c.tags_joined, CASE WHEN f.tag[1] = '#' THEN f.tag[2:] ELSE f.tag END)
GROUP BY f.tag"""

ORACLE["upsert_chunks"] = "WITH " + CHUNKS_CTE + "," + EXISTING_CTE + """
SELECT chunk_id, file, pos, tags_joined, 'existing' AS origin FROM existing_d
UNION ALL
SELECT chunk_id, file, pos, tags_joined, 'inserted' AS origin FROM incoming_d
WHERE chunk_id NOT IN (SELECT chunk_id FROM existing_d)"""

ORACLE["filter_by_tag"] = "WITH " + CHUNKS_CTE + """
SELECT chunk_id, file, pos, tags_joined FROM chunks WHERE contains(tags_joined, 'incode')"""

ORACLE["filter_by_tag_exact"] = "WITH " + CHUNKS_CTE + """
SELECT chunk_id, file, pos, tags_joined FROM chunks WHERE list_contains(tags, 'en')"""

ORACLE["sync_report"] = "WITH " + CHUNKS_CTE + "," + EXISTING_CTE + """,
flagged AS (
  SELECT file, n_chars >= 50 AS kept,
         CASE WHEN n_chars >= 50 THEN file || '_' || substr(sha256(text), 1, 16) END AS chunk_id
  FROM all_chunks
),
present_f AS (
  SELECT f.*, f.chunk_id IN (SELECT chunk_id FROM existing) AS present FROM flagged f
)
SELECT file, count(*) AS n_pieces,
       CAST(sum(CASE WHEN NOT kept THEN 1 ELSE 0 END) AS BIGINT) AS n_short,
       CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS BIGINT) AS n_chunks,
       count(DISTINCT chunk_id) AS n_ids,
       count(DISTINCT CASE WHEN NOT present THEN chunk_id END) AS n_inserted,
       count(DISTINCT CASE WHEN present THEN chunk_id END) AS n_existing
FROM present_f GROUP BY ROLLUP (file)"""

ORACLE["corpus_report"] = "WITH " + CHUNKS_CTE + """,
lens AS (SELECT file, length(text) AS n_chars, tags FROM chunks),
hist AS (SELECT n_chars, count(*) AS n FROM lens GROUP BY n_chars),
cum AS (SELECT n_chars, sum(n) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
               sum(n) OVER () AS total FROM hist)
SELECT 'n_files' AS metric, CAST(count(DISTINCT file) AS BIGINT) AS value FROM lens
UNION ALL SELECT 'n_chunks', CAST(count(*) AS BIGINT) FROM lens
UNION ALL SELECT 'total_chars', CAST(sum(n_chars) AS BIGINT) FROM lens
UNION ALL SELECT 'min_chars', CAST(min(n_chars) AS BIGINT) FROM lens
UNION ALL SELECT 'max_chars', CAST(max(n_chars) AS BIGINT) FROM lens
UNION ALL SELECT 'n_untagged', CAST(sum(CASE WHEN len(tags) = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM lens
UNION ALL SELECT 'n_tags', CAST(count(DISTINCT tag) AS BIGINT) FROM (SELECT unnest(tags) AS tag FROM lens)
UNION ALL SELECT 'p50', CAST(min(CASE WHEN c >= ceil(total * 0.5) THEN n_chars END) AS BIGINT) FROM cum
UNION ALL SELECT 'p90', CAST(min(CASE WHEN c >= ceil(total * 0.9) THEN n_chars END) AS BIGINT) FROM cum
UNION ALL SELECT 'p99', CAST(min(CASE WHEN c >= ceil(total * 0.99) THEN n_chars END) AS BIGINT) FROM cum"""


# ---------------------------------------------------------------- audit
HW_RE2 = "(?i)\\b(" + fixed.HARDWARE_EXCLUSION_WORDS + ")\\b"
ACC_RE2 = "(?i)\\b(" + fixed.ACCURACY_CLAIM_WORDS + ")\\b"


def audit_sql(t: str) -> str:
    """Columns of the audit verdict for text expression ``t`` (DuckDB)."""
    hw = f"coalesce(regexp_matches({t}, '{HW_RE2}'), false)"
    acc = f"coalesce(regexp_matches({t}, '{ACC_RE2}'), false)"
    d = f"coalesce(contains({t}, '[D]'), false)"
    e = f"coalesce(contains({t}, '[E]'), false)"
    m = f"coalesce(contains({t}, '[M]'), false)"
    viol = f"(({hw} OR {acc}) AND ({d} OR {e}) AND NOT {m})"
    claim = f"CASE WHEN {viol} THEN CASE WHEN {hw} THEN 'hardware exclusion' ELSE 'accuracy claim' END END"
    tags = f"(CASE WHEN {d} THEN '[D]' ELSE '' END || CASE WHEN {e} THEN '[E]' ELSE '' END)"
    vtext = (f"CASE WHEN {viol} THEN 'Section 12.5 Rule 7 Violation: ' || {claim} || "
             f"' supported solely by ' || {tags} || ' without measured [M] benchmark data.' END")
    warn = f"CASE WHEN {viol} THEN '{fixed.WARNING_PREFIX}' || {vtext} ELSE '' END"
    return (f"{hw} AS has_hw_exclusion, {acc} AS has_accuracy_claim, NOT {viol} AS compliant, "
            f"{claim} AS claim_type, {vtext} AS violation, {warn} AS warning")


AUDITED_CTE = f"""
claims AS ({derived_sql('claims')}),
audited AS (SELECT claim_id, source, text, {audit_sql('text')} FROM claims)"""

ORACLE["audit_claims"] = "WITH " + AUDITED_CTE + """
SELECT claim_id, source, has_hw_exclusion, has_accuracy_claim, compliant, claim_type, violation, warning
FROM audited"""

ORACLE["compliance_report"] = "WITH " + AUDITED_CTE + """
SELECT source, count(*) AS n_rows,
  CAST(sum(CASE WHEN NOT compliant THEN 1 ELSE 0 END) AS BIGINT) AS n_violations,
  CAST(sum(CASE WHEN claim_type = 'hardware exclusion' THEN 1 ELSE 0 END) AS BIGINT) AS n_hw_exclusion,
  CAST(sum(CASE WHEN claim_type = 'accuracy claim' THEN 1 ELSE 0 END) AS BIGINT) AS n_accuracy,
  CAST(sum(CASE WHEN has_hw_exclusion OR has_accuracy_claim THEN 1 ELSE 0 END) AS BIGINT) AS n_claims,
  CAST(sum(CASE WHEN NOT compliant THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS violation_rate
FROM audited GROUP BY ROLLUP (source)"""

ORACLE["annotate_noncompliant"] = "WITH " + AUDITED_CTE + """,
ann AS (SELECT claim_id, CASE WHEN NOT compliant THEN text || chr(10) || chr(10) || warning ELSE text END AS a
        FROM audited)
SELECT claim_id, length(a) AS n_chars, sha256(a) AS sha256 FROM ann"""


# ---------------------------------------------------------------- routing
def interval_sql(d: str) -> str:
    """Score-interval columns for raw distance expression ``d`` (DOUBLE or NULL)."""
    c = (f"(CASE WHEN ({d}) IS NULL OR isnan({d}) OR isinf({d}) OR ({d}) < 0 THEN 0.0::DOUBLE "
         f"ELSE least(({d}), 1000000.0::DOUBLE) END)")
    point = py_round(f"100.0::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + {c}))", 1)
    margin = py_round(f"5.0::DOUBLE * (1.0::DOUBLE + {c})", 1)
    low = f"greatest(0.0::DOUBLE, {py_round(f'greatest({point} - {margin}, 0.0::DOUBLE)', 1)})"
    high = f"least(100.0::DOUBLE, {py_round(f'{point} + {margin}', 1)})"
    return (f"{low} AS lower_bound, {high} AS upper_bound, 0.95::DOUBLE AS confidence_level, "
            f"{point} AS point_estimate")


DECIDED_CTE = f"""
req AS ({derived_sql('requests')}),
d0 AS (
  SELECT *,
    CASE WHEN product_class IN ('PRODUCT_A', 'PRODUCT_B', 'PRODUCT_C') THEN product_class
         WHEN coalesce(is_difference_calc, false) THEN 'PRODUCT_C'
         WHEN coalesce(has_experimental_reference, false) OR coalesce(has_template, false) THEN 'PRODUCT_B'
         ELSE 'PRODUCT_A' END AS cls,
    coalesce(CASE WHEN regexp_matches(num_atoms, '^\\s*[+-]?[0-9]+\\s*$')
                  THEN TRY_CAST(trim(num_atoms) AS BIGINT) END, 10) AS n_atoms,
    coalesce(is_vdw_complex, false)
      OR contains(lower(coalesce(query, 'Method routing decision query')), 'van der waals')
      OR contains(lower(coalesce(query, 'Method routing decision query')), 'vdw') AS vdw,
    lower(coalesce(engine, 'orca')) AS eng,
    lower(coalesce(method_type, 'dft')) AS meth
  FROM req
),
d1 AS (
  SELECT *,
    CASE WHEN n_atoms <= 10 THEN 'small' WHEN n_atoms <= 50 THEN 'medium' ELSE 'large' END AS size_bucket,
    CASE WHEN vdw THEN 'MPQC'
         WHEN coalesce(require_anharmonic_vpt2, false)
              AND (contains(meth, 'coupled_cluster') OR contains(meth, 'cc') OR contains(eng, 'cfour')) THEN 'CFOUR'
         WHEN coalesce(gpu_available, false) AND contains(eng, 'pyscf') THEN 'PYSCF'
         ELSE 'ORCA' END AS trk,
    CASE WHEN coalesce(has_experimental_reference, false) THEN '[M]'
         WHEN cls IN ('PRODUCT_B', 'PRODUCT_C') THEN '[D]' ELSE '[E]' END AS prov
  FROM d0
),
decided AS (
  SELECT *,
    CASE WHEN recommended_tier IN ('T1-10s', 'T1-1min', 'T1-30min', 'T2-1h', 'T2-3h', 'T2-12h',
                                   'T3-12h', 'T3-1d', 'T3-3d', 'T4-1w', 'T4-1mo') THEN recommended_tier
         WHEN vdw THEN 'T1-30min'
         WHEN cls = 'PRODUCT_A' THEN CASE size_bucket WHEN 'small' THEN 'T3-12h' WHEN 'medium' THEN 'T2-3h' ELSE 'T1-30min' END
         ELSE CASE size_bucket WHEN 'small' THEN 'T1-30min' WHEN 'medium' THEN 'T1-1min' ELSE 'T1-10s' END
    END AS tier,
    CASE WHEN chroma_distance IS NULL THEN 0.1::DOUBLE
         ELSE coalesce(TRY_CAST(trim(chroma_distance) AS DOUBLE), 0.1::DOUBLE) END AS dist
  FROM d1
),
routed AS (
  SELECT request_id, coalesce(query, 'Method routing decision query') AS query,
    tier AS recommended_tier, cls AS product_class, trk AS track, prov AS provenance_tag,
    'Recommended Row: ' || tier || ' under Product Class ' || cls || ' (' || trk || ' Track) ' || prov || '. ' ||
    CASE WHEN vdw AND trk = 'MPQC'
         THEN 'For van der Waals complexes, using MPQC with cc-pVTZ-F12 as the Tier 1 default.'
         ELSE 'VPT2 handling routed to ' || trk || ' per Section 9.' END AS answer,
    {interval_sql('dist')}
  FROM decided
),
routed_c AS (
  SELECT r.*, a.compliant AS section_12_5_compliant
  FROM routed r, LATERAL (SELECT {audit_sql('r.answer')}) a
)"""

ORACLE["product_class"] = "WITH " + DECIDED_CTE + "\nSELECT request_id, cls AS product_class FROM decided"
ORACLE["size_bucket"] = "WITH " + DECIDED_CTE + "\nSELECT request_id, n_atoms, size_bucket FROM decided"
ORACLE["select_track"] = "WITH " + DECIDED_CTE + "\nSELECT request_id, vdw, trk AS track FROM decided"
ORACLE["recommend_tier"] = "WITH " + DECIDED_CTE + "\nSELECT request_id, tier AS recommended_tier FROM decided"
ORACLE["provenance"] = "WITH " + DECIDED_CTE + "\nSELECT request_id, prov AS provenance_tag FROM decided"

ORACLE["route_requests"] = "WITH " + DECIDED_CTE + """
SELECT request_id, query, recommended_tier, product_class, track, provenance_tag,
       section_12_5_compliant, answer, lower_bound, upper_bound, confidence_level, point_estimate,
       10 AS n_priorities, '1. Core-valence basis set expansion' AS first_priority
FROM routed_c"""

ORACLE["route_summary"] = "WITH " + DECIDED_CTE + """
SELECT product_class, track, recommended_tier, count(*) AS n_requests,
       grouping(product_class) * 4 + grouping(track) * 2 + grouping(recommended_tier) AS grouping_level
FROM routed_c GROUP BY CUBE (product_class, track, recommended_tier)"""

ORACLE["enrich_class"] = "WITH " + DECIDED_CTE + """,
dim(product_class, description, window_low_pct, window_high_pct, floppy_low_pct, floppy_high_pct) AS (
  VALUES ('PRODUCT_A', 'De Novo Absolute', 0.3::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE),
         ('PRODUCT_B', 'Semi-Experimental / Template-Anchored', 0.03::DOUBLE, 0.1::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
         ('PRODUCT_C', 'Differences / Relative', 0.03::DOUBLE, 0.1::DOUBLE, NULL::DOUBLE, NULL::DOUBLE)
)
SELECT r.request_id, r.product_class, d.description, d.window_low_pct, d.window_high_pct,
       d.floppy_low_pct, d.floppy_high_pct
FROM routed_c r LEFT JOIN dim d ON r.product_class = d.product_class"""

_FAULTED = """,
faulted AS (
  SELECT request_id,
    CASE WHEN request_id % 53 = 0 THEN 'T9-bad' ELSE recommended_tier END AS recommended_tier,
    CASE WHEN request_id % 59 = 0 THEN NULL ELSE track END AS track,
    CASE WHEN request_id % 61 = 0 THEN '[X]' ELSE provenance_tag END AS provenance_tag,
    CASE WHEN request_id % 71 = 0 THEN 'PRODUCT_Z' ELSE product_class END AS product_class,
    CASE WHEN request_id % 73 = 0 THEN NULL ELSE answer END AS answer,
    query, section_12_5_compliant, lower_bound,
    CASE WHEN request_id % 67 = 0 THEN NULL ELSE upper_bound END AS upper_bound,
    confidence_level
  FROM routed_c
)"""
_RULES = (
    [(f"required:{f}", f"{f} IS NULL") for f in fixed.RESPONSE_REQUIRED]
    + [("enum:recommended_tier", "recommended_tier NOT IN ("
        + ", ".join(f"'{t}'" for t in fixed.VALID_TIERS) + ")"),
       ("enum:product_class", "product_class NOT IN ('PRODUCT_A', 'PRODUCT_B', 'PRODUCT_C')"),
       ("enum:track", "track NOT IN ('ORCA', 'CFOUR', 'PYSCF', 'MPQC')"),
       ("enum:provenance_tag", "provenance_tag NOT IN ('[M]', '[D]', '[E]')")]
    + [(f"interval:{f}", f"{f} IS NULL") for f in fixed.INTERVAL_REQUIRED]
)
ORACLE["contract_check"] = "WITH " + DECIDED_CTE + _FAULTED + "\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS rule, CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM faulted"
    for name, cond in _RULES)


# ---------------------------------------------------------------- capacity
def _mem_cols(raw: str) -> str:
    n = (f"(CASE WHEN {raw} IS NULL OR {raw} = '' THEN 1 "
         f"WHEN NOT regexp_matches({raw}, '^\\s*[+-]?[0-9]+\\s*$') THEN 10 "
         f"ELSE greatest(TRY_CAST(trim({raw}) AS BIGINT), 1) END)")
    nd = f"CAST({n} AS DOUBLE)"
    mace = py_round(f"0.5::DOUBLE + {nd} * 0.005::DOUBLE", 3)
    dft = py_round(f"1.0::DOUBLE + 259200.0::DOUBLE * ({nd} * {nd}) / 1073741824.0::DOUBLE", 3)
    return f"{n} AS n_atoms, {mace} AS mace_gb, {dft} AS dft_gb"


MEM_CTE = f"""
req AS ({derived_sql('requests')}),
mem AS (
  SELECT request_id, method_type, {_mem_cols('num_atoms')} FROM req
)"""

ORACLE["estimate_memory"] = "WITH " + MEM_CTE + """
SELECT request_id, n_atoms, mace_gb, dft_gb,
       CASE WHEN contains(upper(coalesce(method_type, '')), 'MACE') THEN mace_gb ELSE dft_gb END AS vram_gb
FROM mem"""

ORACLE["route_hardware"] = "WITH " + MEM_CTE + f""",
jobs AS ({derived_sql('jobs')}),
hosts AS ({derived_sql('hosts')}),
routed AS (
  SELECT j.host_id,
    CASE WHEN coalesce(h.mace_registered, false) AND coalesce(m.mace_gb, 0.505::DOUBLE) < coalesce(h.vram_gb, 0.0::DOUBLE) THEN 'GPU_MACE'
         WHEN coalesce(m.dft_gb, 1.0::DOUBLE) < coalesce(h.vram_gb, 0.0::DOUBLE) THEN 'GPU_DFT'
         ELSE 'CPU_ORCA' END AS hw_tier
  FROM jobs j LEFT JOIN mem m ON j.request_id = m.request_id LEFT JOIN hosts h ON j.host_id = h.host_id
)
SELECT host_id, hw_tier, count(*) AS n_jobs FROM routed GROUP BY host_id, hw_tier"""

ORACLE["route_all_hosts"] = "WITH " + MEM_CTE + f""",
jobs AS ({derived_sql('jobs')}),
hosts AS ({derived_sql('hosts')}),
pairs AS (
  SELECT h.host_id,
    CASE WHEN coalesce(h.mace_registered, false) AND coalesce(m.mace_gb, 0.505::DOUBLE) < coalesce(h.vram_gb, 0.0::DOUBLE) THEN 'GPU_MACE'
         WHEN coalesce(m.dft_gb, 1.0::DOUBLE) < coalesce(h.vram_gb, 0.0::DOUBLE) THEN 'GPU_DFT'
         ELSE 'CPU_ORCA' END AS hw_tier
  FROM jobs j LEFT JOIN mem m ON j.request_id = m.request_id CROSS JOIN hosts h
)
SELECT host_id, hw_tier, count(*) AS n_jobs FROM pairs GROUP BY host_id, hw_tier"""


# ---------------------------------------------------------------- retrieval
VEC_CTE = """
emb_x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
          FROM embeddings),
cent AS (SELECT label AS query_id, pos, avg(CAST(x AS DOUBLE)) AS c FROM emb_x GROUP BY label, pos),
cent_n AS (SELECT query_id, sqrt(sum(c * c)) AS cn FROM cent GROUP BY query_id),
emb_n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS en FROM emb_x GROUP BY vec_id),
l2 AS (
  SELECT c.query_id, e.vec_id, e.label,
         sum((CAST(e.x AS DOUBLE) - c.c) * (CAST(e.x AS DOUBLE) - c.c)) AS distance,
         sum(CAST(e.x AS DOUBLE) * c.c) AS dot
  FROM emb_x e JOIN cent c ON e.pos = c.pos GROUP BY c.query_id, e.vec_id, e.label
)"""


def _topk(src: str, k: int, dist: str = "distance", extra: str = "") -> str:
    return f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {half_up(dist, 6)} AS distance{extra}
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {dist}, vec_id) AS rank FROM {src})
WHERE rank <= {k}"""


ORACLE["dense_topk"] = "WITH " + VEC_CTE + _topk("l2", 5)
ORACLE["dense_topk_cosine"] = "WITH " + VEC_CTE + """,
cos AS (SELECT l.query_id, l.vec_id, 1.0::DOUBLE - l.dot / (e.en * c.cn) AS cd
        FROM l2 l JOIN emb_n e USING (vec_id) JOIN cent_n c USING (query_id))""" + _topk("cos", 5, "cd").replace(
    f"{half_up('cd', 6)} AS distance", f"{half_up('cd', 6)} AS distance")
ORACLE["filtered_topk"] = "WITH " + VEC_CTE + _topk("(SELECT * FROM l2 WHERE label = query_id)", 5)
ORACLE["topk_with_fallback"] = "WITH " + VEC_CTE + """,
flt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
                       FROM l2 WHERE label = query_id * 2) WHERE rank <= 3),
miss AS (SELECT DISTINCT query_id FROM cent WHERE query_id NOT IN (SELECT query_id FROM flt)),
unf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
                       FROM l2 WHERE query_id IN (SELECT query_id FROM miss)) WHERE rank <= 3)
""" + f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {half_up('distance', 6)} AS distance,
       false AS used_fallback FROM flt
UNION ALL
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {half_up('distance', 6)} AS distance,
       true AS used_fallback FROM unf"""


def lexical_cte(q_sql: str, q_key: str, q_text: str, c_sql: str, c_key: str, c_text: str, k: int,
                p: str = "") -> str:
    """Term-count cosine top-k between two text sets (integer counts).
    CTE names carry the prefix ``p``; the result CTE is ``{p}hits``."""
    return f"""
{p}qt AS (SELECT {q_key} AS query_id, unnest(regexp_split_to_array(lower({q_text}), '[^\\p{{L}}]+')) AS term
       FROM ({q_sql})),
{p}q_tf AS (SELECT query_id, term, count(*) AS tf FROM {p}qt WHERE term <> '' GROUP BY query_id, term),
{p}q_n AS (SELECT query_id, sum(tf * tf) AS nq FROM {p}q_tf GROUP BY query_id),
{p}ct AS (SELECT {c_key} AS cid, unnest(regexp_split_to_array(lower({c_text}), '[^\\p{{L}}]+')) AS term
       FROM ({c_sql})),
{p}c_tf AS (SELECT cid, term, count(*) AS tf FROM {p}ct WHERE term <> '' GROUP BY cid, term),
{p}c_n AS (SELECT cid, sum(tf * tf) AS nc FROM {p}c_tf GROUP BY cid),
{p}dots AS (SELECT q.query_id, c.cid, sum(q.tf * c.tf) AS dot FROM {p}q_tf q JOIN {p}c_tf c ON q.term = c.term
         GROUP BY q.query_id, c.cid),
{p}scored AS (SELECT d.query_id, d.cid, 1.0::DOUBLE - CAST(d.dot AS DOUBLE) / sqrt(CAST(qn.nq * cn.nc AS DOUBLE)) AS distance
           FROM {p}dots d JOIN {p}q_n qn USING (query_id) JOIN {p}c_n cn USING (cid)),
{p}hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, cid, distance FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cid) AS rank FROM {p}scored)
         WHERE rank <= {k})"""


LEX_BENCH = lexical_cte("SELECT * FROM benchmark", "item_id", "text",
                        "SELECT * FROM documents", "doc_id", "text", 3)

ORACLE["lexical_topk"] = "WITH " + LEX_BENCH + """
SELECT query_id, rank, cid AS doc_id, distance FROM hits"""

ORACLE["score_intervals"] = "WITH " + LEX_BENCH + f""",
iv AS (SELECT query_id, rank, cid AS doc_id, {interval_sql('distance')} FROM hits)
SELECT query_id, rank, doc_id, lower_bound, upper_bound, point_estimate,
       CAST(lower_bound AS VARCHAR) || '% - ' || CAST(upper_bound AS VARCHAR) || '% (95% Conformal)' AS confidence
FROM iv"""

CONTEXT_CTE = "WITH " + LEX_BENCH + f""",
iv AS (SELECT query_id, rank, cid, {interval_sql('distance')} FROM hits),
blk AS (
  SELECT iv.query_id, iv.rank,
    {_fill(fixed.CONTEXT_BLOCK, source='d.source', level="'95'", lower='CAST(iv.lower_bound AS VARCHAR)',
           upper='CAST(iv.upper_bound AS VARCHAR)', doc='d.text',
           tag="CASE WHEN a.compliant THEN '[Section 12.5 Verified: Compliant]' ELSE a.warning END")} AS block
  FROM iv JOIN documents d ON iv.cid = d.doc_id,
  LATERAL (SELECT {audit_sql('d.text')}) a
),
ctx AS (
  SELECT b.item_id AS query_id,
         coalesce((SELECT string_agg(block, chr(10) ORDER BY rank) FROM blk WHERE blk.query_id = b.item_id), '') AS context
  FROM benchmark b
)"""

ORACLE["assemble_context"] = CONTEXT_CTE + """
SELECT query_id, length(context) AS n_chars, sha256(context) AS sha256 FROM ctx"""

ORACLE["chat_prompts"] = CONTEXT_CTE + f""",
pr AS (
  SELECT c.query_id, CASE WHEN c.context = '' THEN b.text
         ELSE {_fill(fixed.SHORT_PROMPT, context='c.context', question='b.text')} END AS prompt
  FROM ctx c JOIN benchmark b ON c.query_id = b.item_id
)
SELECT query_id, length(prompt) AS n_chars, sha256(prompt) AS sha256 FROM pr"""

_COLLECTION = """
col AS (SELECT chunk_id, any_value(text) AS text, any_value(tags_joined) AS tags_joined FROM chunks GROUP BY chunk_id)"""
# per tag a search of its own, as the filter comes before the top-k
_TAGGED = ", ".join(
    lexical_cte(f"SELECT * FROM benchmark WHERE item_id % 4 = {r}", "item_id", "text", f"SELECT * FROM col{where}",
                "chunk_id", "text", 3, f"t{r}_").strip()
    for r, where in enumerate((" WHERE contains(tags_joined, 'incode')", " WHERE contains(tags_joined, 'troubleshooting')",
                               " WHERE contains(tags_joined, 'absent')", "")))
_ANY = lexical_cte("SELECT * FROM benchmark", "item_id", "text", "SELECT * FROM col", "chunk_id", "text", 3, "a_")
ORACLE["chunk_search"] = "WITH " + CHUNKS_CTE + "," + _COLLECTION + "," + _ANY + """
SELECT query_id, rank, cid AS chunk_id, distance FROM a_hits"""
ORACLE["filtered_search"] = "WITH " + CHUNKS_CTE + "," + _COLLECTION + ", " + _TAGGED + """
""" + " UNION ALL ".join(f"SELECT query_id, rank, cid AS chunk_id, distance FROM t{r}_hits" for r in range(4))
ORACLE["search_with_fallback"] = "WITH " + CHUNKS_CTE + "," + _COLLECTION + ", " + _TAGGED + "," + _ANY + """,
by_tag AS (""" + " UNION ALL ".join(f"SELECT * FROM t{r}_hits" for r in range(4)) + """)
SELECT query_id, rank, cid AS chunk_id, distance, false AS used_fallback FROM by_tag
UNION ALL
SELECT query_id, rank, cid AS chunk_id, distance, true AS used_fallback FROM a_hits
WHERE query_id NOT IN (SELECT query_id FROM by_tag)"""

ORACLE["approx_topk"] = """
SELECT label AS query_id, 5::BIGINT AS n_hits, true AS recall_reached FROM embeddings GROUP BY label"""

ORACLE["render_chat"] = CONTEXT_CTE + f""",
resp AS (
  SELECT c.query_id,
    CASE WHEN c.context = '' OR starts_with(c.context, '[VAULT ERROR')
         THEN {_lit(fixed.CHAT_HEADER)} || {_fill(fixed.CHAT_NONE, query='b.text')}
         ELSE {_lit(fixed.CHAT_HEADER)} || {_fill(fixed.CHAT_FOUND, query='b.text', context='c.context')} END AS r
  FROM ctx c JOIN benchmark b ON c.query_id = b.item_id
),
final AS (
  SELECT query_id, CASE WHEN NOT a.compliant AND a.warning <> '' THEN r || chr(10) || chr(10) || a.warning ELSE r END AS response
  FROM resp, LATERAL (SELECT {audit_sql('resp.r')}) a
)
SELECT query_id, length(response) AS n_chars, sha256(response) AS sha256 FROM final"""


# ---------------------------------------------------------------- triage
def stem_sql(p: str) -> str:
    name = f"regexp_extract({p}, '([^/]*)/*$', 1)"
    suf = f"regexp_extract({name}, '^(.+)\\.[^.]+$', 1)"
    return f"(CASE WHEN {suf} = '' THEN {name} ELSE {suf} END)"


def signature_sql(tb: str, prefix: str = "app_") -> str:
    lines = f"string_split(trim({tb}, {WS}), chr(10))"
    cands = (f"list_filter(list_transform({lines}, lambda l: trim(l, {WS})), lambda l: l <> '' "
             f"AND NOT starts_with(l, 'File ') AND NOT starts_with(l, 'Traceback'))")
    err = f"({cands})[-1]"
    paths = (f"list_filter(list_transform({lines}, lambda l: regexp_extract(l, 'File\\s+\"([^\"]+)\"', 1)), "
             f"lambda x: x <> '')")
    stems = f"list_filter(list_transform({paths}, lambda x: {stem_sql('x')}), lambda m: starts_with(m, '{prefix}'))"
    mods = f"list_filter({stems}, lambda m, i: list_position({stems}, m) = i)"
    joined = f"concat_ws(' ', nullif(array_to_string({mods}, ' '), ''), {err})"
    return (f"CASE WHEN {tb} IS NULL OR trim({tb}, {WS}) = '' THEN '' "
            f"WHEN {joined} <> '' THEN {joined} ELSE right({tb}, 200) END")


SIG_CTE = f"""
logs AS ({derived_sql('error_logs')}),
sig AS (SELECT *, {signature_sql('traceback')} AS signature FROM logs)"""

ORACLE["error_signatures"] = "WITH " + SIG_CTE + "\nSELECT log_id, signature FROM sig"

ORACLE["error_triage"] = "WITH " + SIG_CTE + """
SELECT signature, n_logs, n_users, first_seen, last_seen, top_module
FROM (SELECT signature, count(*) AS n_logs, count(DISTINCT user_id) AS n_users,
             min(ts) AS first_seen, max(ts) AS last_seen FROM sig GROUP BY signature)
LEFT JOIN (
  SELECT signature, module AS top_module, row_number() OVER (PARTITION BY signature ORDER BY n DESC, module) AS place
  FROM (SELECT signature, module, count(*) AS n FROM (
    SELECT signature, unnest(list_distinct(list_transform(regexp_extract_all(traceback, 'File\\s+"([^"]+)"', 1),
                                                          lambda x: """ + stem_sql("x") + """))) AS module FROM sig)
    GROUP BY signature, module)
) USING (signature) WHERE coalesce(place, 1) = 1"""

TRIAGE_CTE = "WITH " + CHUNKS_CTE + "," + SIG_CTE + f""",
usig AS (SELECT DISTINCT signature FROM sig WHERE signature <> ''),
ck AS (SELECT chunk_id AS ckey, any_value(file) AS file, any_value(text) AS text, any_value(tags_joined) AS tags_joined
       FROM chunks GROUP BY chunk_id),
""" + lexical_cte("SELECT * FROM usig", "signature", "signature",
                  "SELECT * FROM ck WHERE contains(tags_joined, 'troubleshooting')", "ckey", "text", 3, "f_") + """,
miss AS (SELECT signature FROM usig WHERE signature NOT IN (SELECT query_id FROM f_hits)),
""" + lexical_cte("SELECT * FROM miss", "signature", "signature",
                  "SELECT * FROM ck", "ckey", "text", 3, "u_") + f""",
allhits AS (SELECT query_id AS signature, rank, cid AS ckey, distance, false AS used_fallback FROM f_hits
            UNION ALL
            SELECT query_id AS signature, rank, cid AS ckey, distance, true AS used_fallback FROM u_hits),
det AS (
  SELECT h.signature, h.rank, h.used_fallback, ck.file AS source, ck.text AS content,
         {interval_sql('h.distance')}
  FROM allhits h JOIN ck ON h.ckey = ck.ckey
),
det2 AS (
  SELECT *, CAST(lower_bound AS VARCHAR) || '% - ' || CAST(upper_bound AS VARCHAR) || '% (95% Conformal)' AS confidence
  FROM det
)"""

ORACLE["diagnose_errors"] = TRIAGE_CTE + """,
per_sig AS (
  SELECT signature, count(*) AS n_hits, bool_or(used_fallback) AS used_fallback,
         string_agg(source, ',' ORDER BY rank) AS sources,
         arg_min(lower_bound, rank) AS best_lower, arg_min(upper_bound, rank) AS best_upper
  FROM det2 GROUP BY signature
)
SELECT s.log_id, s.signature, coalesce(p.n_hits, 0) AS n_hits,
       coalesce(p.used_fallback, false) AS used_fallback, coalesce(p.sources, '') AS sources,
       p.best_lower, p.best_upper
FROM sig s LEFT JOIN per_sig p ON s.signature = p.signature"""


ORACLE["build_prompts"] = TRIAGE_CTE + f""",
per_sig AS (
  SELECT signature, string_agg({_fill(fixed.PROMPT_SOURCE, rank='CAST(rank AS VARCHAR)', source='source',
                                     confidence='confidence', content='content')}, chr(10) ORDER BY rank) AS sources
  FROM det2 GROUP BY signature
),
pr AS (
  SELECT s.log_id, concat_ws(chr(10), {_lit(fixed.PROMPT_RULES)},
    CASE WHEN p.sources IS NOT NULL THEN {_lit(fixed.PROMPT_CONTEXT_HEAD)} || chr(10) || p.sources
         ELSE {_lit(fixed.PROMPT_NO_CONTEXT)} END,
    {_fill(fixed.PROMPT_TRACEBACK, traceback="coalesce(s.traceback, 'None')")},
    CASE WHEN s.question IS NOT NULL AND s.question <> '' THEN {_fill(fixed.PROMPT_QUESTION, question='s.question')} END,
    {_lit(fixed.PROMPT_INSTRUCTIONS)}) AS prompt
  FROM sig s LEFT JOIN per_sig p ON s.signature = p.signature
)
SELECT log_id, length(prompt) AS n_chars, sha256(prompt) AS sha256 FROM pr"""

ORACLE["render_summaries"] = TRIAGE_CTE + f""",
per_sig AS (
  SELECT signature, string_agg({_fill(fixed.SUMMARY_ITEM, rank='CAST(rank AS VARCHAR)', source='source', confidence='confidence',
      excerpt="substr(content, 1, 500) || CASE WHEN length(content) > 500 THEN '...' ELSE '' END")}, chr(10) ORDER BY rank) AS items
  FROM det2 GROUP BY signature
),
sm AS (
  SELECT s.log_id, concat_ws(chr(10), {_lit(fixed.SUMMARY_HEAD)}, {_lit(fixed.SUMMARY_NOTE)},
    {_fill(fixed.SUMMARY_DETECTED, signature='s.signature')},
    CASE WHEN p.items IS NOT NULL THEN {_lit(fixed.SUMMARY_DOCS_HEAD)} || chr(10) || p.items
         ELSE {_lit(fixed.SUMMARY_NONE)} END,
    {_lit(fixed.SUMMARY_FOOT)}) AS summary
  FROM sig s LEFT JOIN per_sig p ON s.signature = p.signature
)
SELECT log_id, length(summary) AS n_chars, sha256(summary) AS sha256 FROM sm"""


# ---------------------------------------------------------------- redaction
def geom_sql(t: str) -> str:
    return (f"regexp_replace({t}, '(?is)(\\*\\s*xyz.*?\\n)(.*?)(\\*)', "
            f"'\\1[REDACTED_GEOMETRY_BLOCK]' || chr(10) || '\\3', 'g')")


COORD_RE2 = "([A-Za-z]{1,2})\\s+(-?\\d+\\.\\d{3,})\\s+(-?\\d+\\.\\d{3,})\\s+(-?\\d+\\.\\d{3,})"
MATRIX_RE2 = "(\\s*-?\\d+\\.\\d{4,}\\s+){4,}"
GEOM_RE2 = "(?is)(\\*\\s*xyz.*?\\n)(.*?)(\\*)"


def coord_sql(t: str) -> str:
    return f"regexp_replace({t}, '{COORD_RE2}', '\\1 [REDACTED_COORD] [REDACTED_COORD] [REDACTED_COORD]', 'g')"


def matrix_sql(t: str) -> str:
    return f"regexp_replace({t}, '{MATRIX_RE2}', chr(10) || '[REDACTED_FLOAT_MATRIX]' || chr(10), 'g')"


CHAT_CTE = f"chat AS ({derived_sql('chat')})"


def _chat_digest(expr: str) -> str:
    return (f"WITH {CHAT_CTE}, r AS (SELECT conv_id, turn, {expr} AS r FROM chat)\n"
            "SELECT conv_id, turn, length(r) AS n_chars, sha256(r) AS sha256 FROM r")


ORACLE["redact_blocks"] = _chat_digest(geom_sql("text"))
ORACLE["redact_coords"] = _chat_digest(coord_sql("text"))
ORACLE["redact_matrices"] = _chat_digest(matrix_sql("text"))

# ---------------------------------------------------------------- streams (batch twins), sources
ORACLE["transcript_positions"] = """
SELECT conv_id, turn, role, row_number() OVER w - 1 AS position,
       CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)"""

ORACLE["transcripts"] = """
SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
       CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_user,
       CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_assistant,
       CAST(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS BIGINT) AS n_system
FROM conversations GROUP BY conv_id"""

ORACLE["pulse_status"] = f"""WITH m AS ({derived_sql('metrics')}),
a AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, host, count(*) AS n_samples,
         avg(cpu_pct) AS cpu_pct, max(CAST(is_active AS INTEGER)) AS active
  FROM m GROUP BY 1, 2
)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, host, n_samples,
       {half_up('cpu_pct', 6)} AS cpu_pct, active = 1 AS is_active,
       CASE WHEN active = 0 THEN 'green' WHEN cpu_pct < 80.0 THEN 'orange' ELSE 'red' END AS status
FROM a"""

ORACLE["pulse_status_silent"] = """WITH seen AS (""" + ORACLE["pulse_status"] + """),
gaps AS (SELECT host, window_start, lead(window_start) OVER (PARTITION BY host ORDER BY window_start) AS next,
                max(window_start) OVER () AS last FROM seen),
silent AS (SELECT host, window_start, unnest(range(1, least(3, date_diff('hour', window_start,
             coalesce(next - INTERVAL 1 HOUR, last))) + 1)) AS i FROM gaps)
SELECT window_start, window_end, host, n_samples, cpu_pct, is_active, status FROM seen
UNION ALL
SELECT window_start + i * INTERVAL 1 HOUR, window_start + (i + 1) * INTERVAL 1 HOUR, host, 0, NULL, false, '""" + fixed.STATUS_IDLE + """'
FROM silent"""

ORACLE["error_stream"] = "WITH " + SIG_CTE + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       signature, count(*) AS n_errors
FROM sig GROUP BY 1, 2, 3"""


# ---------------------------------------------------------------- SMILES (lookaround-free twin)
# A maximal run of candidate tokens holds at most one match. It starts at the
# run start when the preceding character is not a word character, else right
# after the run's first bond/bracket character; it ends at the run end when
# the next character is not a word character, else at the run's last
# bond/bracket character; it needs two tokens or more.
_TOK = "(?:Cl|Br|Si|Se|Te|Na|K|Fe|Mg|Ca|Li|Cu|Zn|Al|Pt|Pd|[BCNOPSFIHbcnsoph0-9])"
_PUN = "[()\\[\\]=#@+\\-\\\\/.:%]"
_NOT_PUN = "[^()\\[\\]=#@+\\-\\\\/.:%]"
_RUN = f"(?:{_TOK}|{_PUN})+"
_ANYTOK = f"(?:{_TOK}|{_PUN})"


def smiles_ctes(src: str, keys: list[str], text: str, p: str = "sm_") -> str:
    """CTEs ending in ``{p}out(keys..., r)``: ``text`` of ``src`` with SMILES redacted."""
    k = ", ".join(keys)
    kq = ", ".join(f"x.{c}" for c in keys)
    join = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    return f"""
{p}parts AS (SELECT {k}, {text} AS t, regexp_extract_all({text}, '{_RUN}') AS runs,
                   regexp_split_to_array({text}, '{_RUN}') AS gaps FROM {src}),
{p}ex AS (SELECT {k}, gaps, unnest(runs) AS r, generate_subscripts(runs, 1) AS i FROM {p}parts),
{p}c1 AS (
  SELECT {k}, i, r, gaps[i + 1] AS after_gap,
    right(gaps[i], 1) AS prev, left(gaps[i + 1], 1) AS nxt
  FROM {p}ex
),
{p}c2 AS (
  SELECT *,
    CASE WHEN prev = '' OR NOT regexp_matches(prev, '^[A-Za-z0-9_]$') THEN 0
         ELSE length(regexp_extract(r, '^({_NOT_PUN}*{_PUN})', 1)) END AS off,
    prev = '' OR NOT regexp_matches(prev, '^[A-Za-z0-9_]$')
      OR regexp_matches(r, '{_PUN}') AS has_start
  FROM {p}c1
),
{p}c3 AS (
  SELECT *, CASE WHEN NOT has_start THEN ''
                 WHEN nxt = '' OR NOT regexp_matches(nxt, '^[A-Za-z0-9_]$') THEN substr(r, off + 1)
                 ELSE regexp_extract(substr(r, off + 1), '^(.*){_PUN}', 1) END AS cand
  FROM {p}c2
),
{p}c4 AS (
  SELECT *, len(regexp_extract_all(cand, '{_ANYTOK}')) >= 2 AS is_match FROM {p}c3
),
{p}c5 AS (
  SELECT {k}, i,
    CASE WHEN is_match AND regexp_matches(cand, '[=#\\[\\]@\\\\/0-9]') AND regexp_matches(cand, '[CcNnOoPSFI]|Br')
         THEN substr(r, 1, off) || '[REDACTED_SMILES_STRING]' || substr(r, off + length(cand) + 1)
         ELSE r END || after_gap AS piece
  FROM {p}c4
),
{p}agg AS (SELECT {k}, string_agg(piece, '' ORDER BY i) AS body FROM {p}c5 GROUP BY {k}),
{p}out AS (
  SELECT {kq}, CASE WHEN x.t IS NULL THEN NULL ELSE x.gaps[1] || coalesce(y.body, '') END AS r
  FROM {p}parts x LEFT JOIN {p}agg y ON {join}
)"""


ORACLE["error_stream_replayed"] = ORACLE["error_stream"]

_LABELS = "(len({0}) - len(replace({0}, '[REDACTED_SMILES_STRING]', ''))) // 24"
ORACLE["redaction_report"] = f"""WITH {CHAT_CTE},
s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS s0 FROM chat),
s1 AS (SELECT *, {geom_sql('s0')} AS s1 FROM s),
s2 AS (SELECT *, {coord_sql('s1')} AS s2 FROM s1),
s3 AS (SELECT *, {matrix_sql('s2')} AS s3 FROM s2),
{smiles_ctes('s3', ['conv_id', 'turn'], 's3')},
s4 AS (SELECT s3.*, r AS s4, regexp_replace(r, '\\[REDACTED_[A-Z_]+\\]', ' ', 'g') AS rest
       FROM s3 JOIN sm_out USING (conv_id, turn)),
{smiles_ctes('s4', ['conv_id', 'turn'], 'rest', 'lk_')},
st AS (
  SELECT role,
    len(regexp_extract_all(rest, '{COORD_RE2}')) + len(regexp_extract_all(rest, '{MATRIX_RE2}')) + {_LABELS.format('r')} > 0
      OR len(regexp_extract_all(s4, '{GEOM_RE2}'))
         <> len(regexp_extract_all(s4, '(?i)\\*\\s*xyz[^\\n]*\\n\\[REDACTED_GEOMETRY_BLOCK\\]\\n\\*')) AS leak,
    len(regexp_extract_all(s0, '{GEOM_RE2}')) AS n_g, length(s1) - length(s0) AS d_g,
    len(regexp_extract_all(s1, '{COORD_RE2}')) AS n_c, length(s2) - length(s1) AS d_c,
    len(regexp_extract_all(s2, '{MATRIX_RE2}')) AS n_m, length(s3) - length(s2) AS d_m,
    {_LABELS.format('s4')} - {_LABELS.format('s3')} AS n_s, length(s4) - length(s3) AS d_s
  FROM s4 JOIN lk_out USING (conv_id, turn)
),
long AS (
  SELECT role, leak, 'geometry' AS pattern, n_g AS n, d_g AS delta FROM st
  UNION ALL SELECT role, leak, 'coords', n_c, d_c FROM st
  UNION ALL SELECT role, leak, 'matrix', n_m, d_m FROM st
  UNION ALL SELECT role, leak, 'smiles', n_s, d_s FROM st
)
SELECT role, pattern,
  CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows_hit,
  CAST(sum(n) AS BIGINT) AS n_matches,
  CAST(sum(delta) AS BIGINT) AS chars_delta,
  CAST(sum(CASE WHEN leak THEN 1 ELSE 0 END) AS BIGINT) AS n_leaks
FROM long GROUP BY role, pattern"""

ORACLE["redact_smiles"] = f"""WITH {CHAT_CTE},
src AS (SELECT conv_id, turn, text FROM chat),
{smiles_ctes('src', ['conv_id', 'turn'], 'text')}
SELECT conv_id, turn, length(r) AS n_chars, sha256(r) AS sha256 FROM sm_out"""

ORACLE["redact_text"] = f"""WITH {CHAT_CTE},
src AS (SELECT conv_id, turn, {matrix_sql(coord_sql(geom_sql('text')))} AS text FROM chat),
{smiles_ctes('src', ['conv_id', 'turn'], 'text')}
SELECT conv_id, turn, length(r) AS n_chars, sha256(r) AS sha256 FROM sm_out"""

ORACLE["scrub_conversations"] = f"""WITH {CHAT_CTE},
src AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
               {matrix_sql(coord_sql(geom_sql("coalesce(text, '')")))} AS text
        FROM chat WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
{smiles_ctes('src', ['conv_id', 'turn', 'role'], 'text')}
SELECT conv_id, turn, role, length(r) AS n_chars, sha256(r) AS sha256 FROM sm_out"""
