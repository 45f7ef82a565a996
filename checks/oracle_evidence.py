"""Oracles for evidence lookups, findings, traces and precedents."""

from checks.oracle_base import check_char, gstin_key, gstin_of, number_key

_KNOWN = "(regexp_replace(number, '^CN/', '') || CASE WHEN k % 14 = 0 THEN '/X' ELSE '' END)"

EXTRA = {
    "requests": """
  SELECT exception_id, k, CASE WHEN k % 97 = 0 THEN '' ELSE supplier_gstin END AS gstin, coalesce(b_gstin, p_gstin) AS book_gstin,
    coalesce(b_number, p_number) AS number, CASE WHEN k % 2 = 0 THEN amount_at_risk END AS tax,
    coalesce(p_taxable + p_tax, b_taxable + b_tax) AS value, coalesce(p_irn, b_irn) AS irn FROM keyed""",
    "responses": """
  SELECT case_id, idx, event_type = 'purchase' AND idx >= 3 AS is_final, event_type AS tool,
    CASE WHEN case_id % 2 = 0 THEN '{}' ELSE props END AS args, round(value * 400)::BIGINT AS tokens,
    idx * CASE WHEN case_id % 5 = 0 THEN 25.0 ELSE 4.0 END AS elapsed
  FROM (SELECT *, user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)""",
    "labelled": """
  SELECT *, CASE WHEN elapsed > 120 THEN 'wall_clock_timeout' WHEN spent > 60000 THEN 'spend_cap' WHEN is_final THEN 'completed'
    WHEN idx >= 8 THEN 'step_budget_exhausted' WHEN rep = 1 AND reps >= 2 THEN 'loop_detected' END AS label
  FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY case_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(rep) OVER (PARTITION BY case_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS reps
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY case_id, is_final, tool, args ORDER BY idx) > 1 THEN 1 ELSE 0 END AS rep FROM responses))""",
    "replies": """
  SELECT exception_id, k, regexp_extract(txt, '\\{.*\\}', 0, 's') AS body FROM (SELECT *, CASE k % 8
    WHEN 0 THEN 'x {"proposed_class": "DUPLICATE", "confidence": 0.84, "rationale": "fits", "evidence": [{"tool_call_id": "tc01-query_vendor_master"}]} e'
    WHEN 1 THEN 'nothing to report' WHEN 2 THEN '{"proposed_class": }'
    WHEN 3 THEN '{"proposed_class": "NOT_A_CLASS", "confidence": 0.5, "rationale": "fits", "evidence": [{"tool_call_id": "tc01-query_vendor_master"}]}'
    WHEN 4 THEN '{"proposed_class": "DUPLICATE", "confidence": 0.5, "rationale": "fits", "evidence": [{"tool_call_id": "tc09-invented"}]}'
    WHEN 5 THEN '{"proposed_class": "DUPLICATE", "confidence": "high", "rationale": "fits", "evidence": [{"tool_call_id": "tc01-query_vendor_master"}]}'
    WHEN 6 THEN '{"proposed_class": "DUPLICATE", "confidence": 1.7, "rationale": "  wide  ", "evidence": [{"tool_call_id": "tc01-query_vendor_master"}]}'
    ELSE '{"proposed_class": "DUPLICATE", "confidence": 0.0, "rationale": "fits", "evidence": []}' END AS txt FROM keyed)""",
    "judged_replies": """
  SELECT *, CASE WHEN body = '' THEN 'no JSON object in the reply' WHEN NOT json_valid(body) THEN 'unparseable JSON'
    WHEN json_extract_string(good, '$.proposed_class') <> 'DUPLICATE' THEN 'unusable class or action'
    WHEN json_extract_string(good, '$.evidence[0].tool_call_id') = 'tc09-invented'
      THEN 'evidence cites ''tc09-invented'', which is not a tool call this run made'
    WHEN TRY_CAST(json_extract_string(good, '$.confidence') AS DOUBLE) IS NULL THEN 'confidence is not a number' ELSE '' END AS failure
  FROM (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN body END AS good FROM replies)""",
    "precedents": """
  SELECT 'C1-' || id AS precedent_id, CASE k % 4 WHEN 1 THEN 'MISSING_IN_BOOKS' WHEN 2 THEN 'AMOUNT_MISMATCH' WHEN 3 THEN 'GSTIN_MISMATCH'
      ELSE 'CREDIT_NOTE_UNLINKED' END AS cls, gstin, 'invoice ' || number || ' dated ' || day AS summary,
    CASE WHEN k % 4 = 1 THEN 'query_purchase_register -> query_bank_ledger -> query_vendor_master' ELSE 'query_purchase_register' END AS probes,
    'settled as order ' || k AS resolution
  FROM docs WHERE k % 5 <> 0""",
    "asked": "SELECT DISTINCT cls, supplier_gstin AS gstin FROM exceptions",
    "texts": """
  SELECT 'p' AS side, precedent_id AS id, cls, upper(cls || ' ' || gstin || ' ' || summary) AS t FROM precedents
  UNION ALL SELECT 'q', cls || '~' || gstin, cls, upper(cls || ' ' || gstin) FROM asked""",
    "weights": """
  SELECT side, id, cls, idx, sum(w)::INT AS w FROM (SELECT side, id, cls, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS idx,
      CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END AS w
    FROM (SELECT side, id, cls, sha256(unnest(list_filter(string_split(replace(t, '/', ' '), ' '), lambda x: x <> ''))) AS h FROM texts))
  GROUP BY ALL HAVING sum(w) <> 0""",
    "norms": """
  SELECT t.side, t.id, t.cls, coalesce(sum(w * w), 0)::BIGINT AS nn FROM texts t LEFT JOIN weights w ON w.side = t.side AND w.id = t.id GROUP BY ALL""",
    "ranked": """
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS place FROM (
    SELECT q.id AS qid, q.cls, p.id AS pid, coalesce(d.dot / nullif(sqrt(q.nn * p.nn), 0), 0.0) AS score
    FROM norms q JOIN norms p ON q.side = 'q' AND p.side = 'p' AND p.cls = q.cls
    LEFT JOIN (SELECT a.id AS qid, b.id AS pid, sum(a.w * b.w) AS dot FROM weights a JOIN weights b
      ON a.side = 'q' AND b.side = 'p' AND a.cls = b.cls AND a.idx = b.idx GROUP BY ALL) d ON d.qid = q.id AND d.pid = p.id)""",
    "hits": """
  SELECT r.cls, string_split(qid, '~')[2] AS gstin, place, pid, round(score, 4) AS similarity, p.gstin = string_split(qid, '~')[2] AS same_vendor,
    p.summary, p.probes, p.resolution FROM ranked r JOIN precedents p ON p.precedent_id = r.pid WHERE place <= 3""",
}


def _probe(rows, gstin, number, amount, slack, order, id_, name):
    conditions = [f"(r.gq = '' OR t.g = r.gq)"]
    if number:
        conditions.append("(r.nq = '' OR t.n = r.nq)")
    if amount:
        conditions.append("(r.aq IS NULL OR abs(t.amount - r.aq) <= r.slack)")
    return f"""
SELECT exception_id, count(id)::BIGINT AS match_count, coalesce(string_agg(id, '|' ORDER BY place) FILTER (place <= 8), '') AS {name}
FROM (SELECT r.exception_id, t.id, row_number() OVER (PARTITION BY r.exception_id ORDER BY {order}) AS place
  FROM (SELECT exception_id, {gstin_key(gstin)} AS gq, {number or "''"} AS nq, {amount or 'NULL'} AS aq, {slack} AS slack FROM requests) r
  LEFT JOIN ({rows}) t ON {' AND '.join(conditions)})
GROUP BY exception_id"""


SQL = {
    "probe_register": _probe(
        "SELECT line_id AS id, g, n, total_tax AS amount FROM books_all", "gstin",
        f"CASE WHEN k % 3 = 0 OR k % 97 = 0 THEN {number_key('number')} ELSE '' END", "tax", "1.00", "t.id", "id", "line_ids"),
    "probe_bank": _probe(
        "SELECT payment_id AS id, counterparty_gstin AS g, amount FROM bank", "book_gstin", None,
        "CASE WHEN k % 4 <> 0 THEN value + CASE WHEN k % 10 = 9 THEN 5000000 ELSE 0 END END", "CASE WHEN k % 5 = 0 THEN 5.00 ELSE 1.00 END", "t.id", "id", "payment_ids"),
    "probe_prior_2b": "SELECT x.*, (SELECT count(DISTINCT return_period) FROM prior_portal) AS period_count FROM (" + _probe(
        "SELECT line_id AS id, supplier_gstin AS g, n, return_period FROM prior_portal", "gstin",
        f"CASE WHEN k % 2 = 0 THEN {number_key(_KNOWN)} ELSE '' END",
        None, "0", "t.return_period, t.id", "id", "line_ids") + ") x",
    "probe_vendor": f"""
SELECT exception_id, v.gstin IS NOT NULL AS known_vendor, coalesce(legal_name, '') AS legal_name, coalesce(files_late, FALSE) AS files_late,
  coalesce(risk_flag, '') AS risk_flag, formed AS gstin_well_formed, formed AND {check_char('substr(q, 1, 14)')} = substr(q, 15, 1) AS gstin_checksum_valid
FROM (SELECT *, regexp_matches(q, '^[0-3][0-9][A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]$') AS formed
  FROM (SELECT exception_id, CASE WHEN k % 50 = 49 THEN body || {check_char('body')} ELSE {gstin_key('book_gstin')} END AS q
    FROM (SELECT *, {gstin_of('(k + 7000001)')} AS body FROM requests))) LEFT JOIN vendors v ON v.gstin = q""",
    "probe_irn": """
SELECT exception_id, coalesce(r.irn, '') AS irn, i.status IS NOT NULL AS known, coalesce(i.status, '') AS status,
  coalesce(i.status = 'CANCELLED', FALSE) AS cancelled
FROM (SELECT exception_id, CASE WHEN k % 7 = 0 THEN 'X' || irn ELSE irn END AS irn FROM requests) r LEFT JOIN irn_registry i ON i.irn = r.irn""",
    "findings_validation": """
SELECT exception_id, CASE WHEN failure = '' THEN 'DUPLICATE' ELSE '' END AS proposed_class,
  CASE WHEN failure = '' THEN greatest(0.0, least(1.0, TRY_CAST(json_extract_string(good, '$.confidence') AS DOUBLE))) ELSE -1.0 END::DOUBLE AS confidence,
  CASE WHEN failure = '' THEN trim(json_extract_string(good, '$.rationale')) ELSE '' END AS rationale,
  CASE WHEN failure = '' THEN json_array_length(good, '$.evidence')::BIGINT ELSE -1 END AS citations, 2::BIGINT AS steps_used, failure FROM judged_replies""",
    "trace_termination": """
SELECT case_id, coalesce(min_by(label, idx) FILTER (label IS NOT NULL), 'open') AS terminated_because,
  coalesce(min(idx) FILTER (label IS NOT NULL), max(idx) + 1)::BIGINT AS steps FROM labelled GROUP BY case_id""",
    "prompt_dedupe": "SELECT min(doc_id) AS doc_id, count(*) AS asked FROM documents GROUP BY text",
    "hash_embedding": """
SELECT w.id AS precedent_id, string_agg(idx || ':' || w, ' ' ORDER BY idx) AS vector, sum(w * w)::BIGINT AS norm_squared
FROM weights w WHERE side = 'p' GROUP BY w.id""",
    "precedent_top3": "SELECT cls AS exception_class, gstin, place::BIGINT AS place, pid AS precedent_id, similarity, same_vendor FROM hits",
    "precedent_hints": """
SELECT cls AS exception_class, gstin, string_agg('- ' || summary || ' (probes: ' || probes || '; outcome: ' || resolution || ')', chr(10) ORDER BY place) AS hint
FROM hits GROUP BY cls, gstin""",
    "case_briefs": """
SELECT exception_id, case_text || coalesce(chr(10) || chr(10) || 'Similar cases resolved previously:' || chr(10) || hint, '') AS brief
FROM case_lines c LEFT JOIN (SELECT cls, gstin,
    string_agg('- ' || summary || ' (probes: ' || probes || '; outcome: ' || resolution || ')', chr(10) ORDER BY place) AS hint
  FROM hits GROUP BY cls, gstin) h ON h.cls = c.cls AND h.gstin = c.supplier_gstin""",
    "dense_cosine": """
SELECT vec_id, round(dot / sqrt(nv * nm), 4) AS cosine FROM (
  SELECT vec_id, sum(x * m) AS dot, sum(x * x) AS nv, sum(m * m) AS nm
  FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
  JOIN (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL)
  USING (label, pos) GROUP BY vec_id)""",
}
