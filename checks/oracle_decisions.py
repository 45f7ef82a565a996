"""Oracles for scalar expressions, the gate, submission, audit, review and the cycle."""

from checks.oracle_base import AS_OF, allowed, check_char, fy_start, number_key, time_barred

TAXPAYER = "27AAPFU0939F1ZV"
_KEY = f"substr(sha256('{TAXPAYER}|07-2001|' || exception_id || '|' || action || '|2026.07'), 1, 32)"


def _json_list(x):
    return f"CASE WHEN len({x}) = 0 THEN '[]' ELSE '[\"' || array_to_string({x}, '\",\"') || '\"]' END"


def _entries(place):
    return f"""
  SELECT *, '{{"action":"' || action || '","amount_at_risk":"' || amount_at_risk || '","approver":' ||
      CASE WHEN requires_human THEN 'null' ELSE '"J. Rao"' END || ',"confidence":' || coalesce(confidence::VARCHAR, 'null') ||
      ',"evidence_call_ids":' || coalesce({_json_list('calls')}, '[]') || ',"exception_id":"' || exception_id ||
      '","model":"","previous_digest":"' AS head,
    '","prompt_digest":"' || CASE WHEN cls IN ('MISSING_IN_BOOKS','AMOUNT_MISMATCH','GSTIN_MISMATCH','CREDIT_NOTE_UNLINKED')
      THEN substr(sha256(detail), 1, 16) ELSE '' END || '","reasons":' || {_json_list('reasons')} ||
      ',"recorded_at":"2001-07-14 09:00:00+00:00","requires_human":' || CASE WHEN requires_human THEN 'true' ELSE 'false' END ||
      ',"ruleset_version":"2026.07","sequence":' || place || '}}' AS tail
  FROM (SELECT *, {place} AS place FROM gated)"""


EXTRA = {
    "keyed": "SELECT *, substr(coalesce(pid, bid), 2, 10)::BIGINT AS k FROM exceptions",
    "findings": """
  SELECT exception_id, k, cls AS proposed_class, list_extract(['ACCEPT','REJECT','PENDING'], (k % 3 + 1)::INT) AS proposed_action,
    (k * 37 % 1000) / 1000.0::DOUBLE AS confidence, CASE WHEN k % 19 = 0 THEN '  ' ELSE 'checked order ' || k END AS rationale,
    CASE WHEN k % 11 = 0 THEN []::VARCHAR[] ELSE ['tc00-query_purchase_register', 'tc01-query_vendor_master'] END AS calls
  FROM keyed WHERE cls IN ('MISSING_IN_BOOKS','AMOUNT_MISMATCH','GSTIN_MISMATCH','CREDIT_NOTE_UNLINKED') AND k % 17 <> 0""",
    "gated": """
  SELECT *, CASE
      WHEN cls IN ('DUPLICATE','CANCELLED_IRN','RCM','TIME_BARRED') THEN [cls || ' is closed by rule under ruleset 2026.07']
      WHEN proposed_action IS NULL THEN ['no finding available; held pending rather than actioned']
      WHEN NOT sound THEN ['finding carries no tool-referenced evidence chain; refusing to action a decision that cannot be explained']
      WHEN confidence < 0.75 THEN ['confidence ' || format('{:.2f}', confidence) || ' below floor 0.75']
      ELSE ['agent proposed ' || proposed_action || ' with confidence ' || format('{:.2f}', confidence),
        CASE WHEN proposed_action = 'REJECT' THEN 'reject purges the value from 2B for this period; human approval required'
          WHEN proposed_action = 'ACCEPT' AND amount_at_risk > 25000 THEN 'tax value ' || amount_at_risk || ' exceeds the auto-accept ceiling 25000.00'
          ELSE 'within straight-through limits' END] END AS reasons
  FROM (SELECT *, CASE WHEN cls IN ('DUPLICATE','CANCELLED_IRN') THEN 'REJECT' WHEN cls IN ('RCM','TIME_BARRED') THEN 'PENDING'
      WHEN proposed_action IS NULL OR NOT sound OR confidence < 0.75 THEN 'PENDING' ELSE proposed_action END AS action,
    CASE WHEN cls IN ('DUPLICATE','CANCELLED_IRN') THEN TRUE WHEN cls IN ('RCM','TIME_BARRED') THEN FALSE
      WHEN proposed_action IS NULL OR NOT sound OR confidence < 0.75 THEN TRUE
      ELSE proposed_action = 'REJECT' OR (proposed_action = 'ACCEPT' AND amount_at_risk > 25000) END AS requires_human,
    cls NOT IN ('DUPLICATE','CANCELLED_IRN','RCM','TIME_BARRED')
      AND (proposed_action IS NULL OR NOT sound OR confidence < 0.75) AS escalated
  FROM (SELECT x.*, f.proposed_action, f.confidence, f.rationale, f.calls, trim(f.rationale) <> '' AND len(f.calls) > 0 AS sound
    FROM keyed x LEFT JOIN findings f USING (exception_id)))""",
    "presented": f"""
  SELECT exception_id, action, seq AS ord, {_KEY} AS key FROM gated WHERE action IN ('ACCEPT','REJECT')
  UNION ALL SELECT exception_id, action, seq + 10000000, {_KEY} FROM gated WHERE action IN ('ACCEPT','REJECT') AND seq % 3 = 0""",
    "held": f"SELECT exception_id, action, {_KEY} AS key FROM gated WHERE action IN ('ACCEPT','REJECT') AND seq % 5 = 0",
    "sent": """
  SELECT *, CASE WHEN key NOT IN (SELECT key FROM held) AND row_number() OVER (PARTITION BY key ORDER BY ord) = 1
    THEN 'APPLIED' ELSE 'ALREADY_APPLIED' END AS outcome FROM presented""",
    "entries": _entries("row_number() OVER (PARTITION BY cls ORDER BY seq) - 1"),
    "chain": """
  SELECT cls, place, exception_id, repeat('0', 64) AS previous, sha256(head || repeat('0', 64) || tail) AS digest FROM entries WHERE place = 0
  UNION ALL SELECT e.cls, e.place, e.exception_id, c.digest, sha256(e.head || c.digest || e.tail)
  FROM chain c JOIN entries e ON e.cls = c.cls AND e.place = c.place + 1""",
    "queue": """
  SELECT *, substr(sha256(array_to_string([exception_id, cls, action, amount_at_risk::VARCHAR, rationale2,
      coalesce(format('{:.4f}', confidence), ''), array_to_string(reasons, '|'),
      array_to_string(list_transform(calls2, lambda c: c || ':case ' || k), '|')], '␟')), 1, 32) AS confirmation
  FROM (SELECT *, coalesce(rationale, '') AS rationale2, coalesce(calls, []::VARCHAR[]) AS calls2,
    coalesce(b_number, p_number) AS invoice_number, seq - 1 AS audit_sequence FROM gated WHERE requires_human)""",
    "approvals": """
  SELECT audit_sequence * 2 + n AS ord, CASE WHEN k % 29 = 0 THEN 'X' || exception_id ELSE exception_id END AS target,
    CASE WHEN k % 13 = n THEN '' ELSE 'A. Iyer' END AS name,
    list_extract(['APPROVE','OVERRIDE','HOLD'], ((k + n) % 3 + 1)::INT) AS review_action,
    CASE WHEN k % 7 = n THEN 'stale' ELSE confirmation END AS shown,
    CASE k % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'NO_ACTION' WHEN 2 THEN 'REJECT' END AS override,
    CASE WHEN k % 2 = 0 THEN 'seen' ELSE '' END AS note
  FROM queue, (SELECT unnest([0, 1]) AS n)""",
    "judged": """
  SELECT *, CASE WHEN fault = 'unknown' THEN 'unknown' WHEN ord > win THEN 'already_resolved'
    WHEN fault IS NOT NULL THEN fault ELSE 'resolved' END AS status
  FROM (SELECT *, min(CASE WHEN fault IS NULL THEN ord END) OVER (PARTITION BY target) AS win
  FROM (SELECT a.*, q.reasons, q.amount_at_risk,
    CASE review_action WHEN 'APPROVE' THEN q.action WHEN 'HOLD' THEN 'PENDING'
      ELSE CASE WHEN override IN ('ACCEPT','REJECT','PENDING') THEN override END END AS final,
    CASE WHEN q.exception_id IS NULL THEN 'unknown' WHEN a.name = '' THEN 'unnamed' WHEN a.shown <> q.confirmation THEN 'stale'
      WHEN review_action = 'OVERRIDE' AND coalesce(override NOT IN ('ACCEPT','REJECT','PENDING'), TRUE) THEN 'bad_override' END AS fault
  FROM approvals a LEFT JOIN queue q ON q.exception_id = a.target))""",
    "case_lines": """
  SELECT *, 'Exception ' || exception_id || ' classified by rules as ' || cls || '.' || chr(10) || detail || chr(10) ||
    CASE WHEN b_number IS NULL THEN 'No counterpart in the purchase register.' ELSE 'In the purchase register: invoice ' || b_number ||
      ' dated ' || b_date || ' from GSTIN ' || b_gstin || ', taxable ' || b_taxable || ', total tax ' || b_tax || coalesce(', IRN ' || b_irn, '') || '.' END || chr(10) ||
    CASE WHEN p_number IS NULL THEN 'No counterpart in the GSTR-2B.' ELSE 'In the GSTR-2B: invoice ' || p_number ||
      ' dated ' || p_date || ' from GSTIN ' || p_gstin || ', taxable ' || p_taxable || ', total tax ' || p_tax || coalesce(', IRN ' || p_irn, '') || '.' END AS case_text
  FROM exceptions""",
    "playbook": """
  SELECT * FROM (VALUES
    ('MISSING_IN_BOOKS', 'ACCEPT', ['query_purchase_register','query_bank_ledger','query_vendor_master']),
    ('AMOUNT_MISMATCH', 'PENDING', ['compute_tolerance_match','query_purchase_register']),
    ('GSTIN_MISMATCH', 'ACCEPT', ['query_vendor_master','query_purchase_register']),
    ('CREDIT_NOTE_UNLINKED', 'PENDING', ['query_prior_2b','query_purchase_register']),
    ('MISSING_IN_2B', 'PENDING', ['query_vendor_master','query_prior_2b'])) t(cls, action, probes)""",
}

_ODD = "substr(line_id, 2, 10)::BIGINT % 9"
_RAW = (
    f"upper(CASE {_ODD} WHEN 2 THEN substr(supplier_gstin, 1, 14) WHEN 3 THEN substr(supplier_gstin, 1, 14) || '0' "
    "ELSE supplier_gstin END)"
)
_STRUCTURE = "length(g) = 15 AND regexp_matches(g, '^[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$')"
_OTHER = (
    "CASE WHEN substr(line_id, 2, 10)::BIGINT % 2 = 0 THEN lower(invoice_number) || ' x' ELSE invoice_number || '/007' END"
)

SQL = {
    "gstin_validation": f"""
SELECT line_id, g AS normalised, formed AS well_formed, formed AND e = substr(g, 15, 1) AS checksum_valid,
  CASE WHEN length(g) <> 15 THEN 'length ' || length(g) || ', expected 15' WHEN NOT formed THEN 'does not match GSTIN structure'
    WHEN e <> substr(g, 15, 1) THEN 'check character ''' || substr(g, 15, 1) || ''', expected ''' || e || '''' ELSE '' END AS reason,
  CASE WHEN formed THEN substr(g, 1, 2) ELSE '' END AS state_code
FROM (SELECT *, {_STRUCTURE} AS formed, {check_char('substr(g, 1, 14)')} AS e FROM (SELECT line_id, {_RAW} AS g FROM books_all))""",
    "invoice_number_normalisation": f"""
SELECT line_id, n AS num_key, len(string_split(n, '|'))::BIGINT AS tokens, x = 'X' AS compatible,
  CASE WHEN x = 'X' THEN 'house-style suffix ''X''' ELSE 'extra identifying tokens (''7'',)' END AS reason,
  CASE WHEN x = 'X' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS affinity
FROM (SELECT *, list_extract(string_split({number_key(_OTHER)}, '|'), -1) AS x FROM portal_all)""",
    "tax_amounts": """
SELECT line_id, total_tax::DOUBLE AS total_tax, (taxable + total_tax)::DOUBLE AS invoice_value, igst > 0 AS interstate,
  NOT ((cgst > 0 OR sgst > 0) AND igst > 0) AS well_formed, round((taxable::DOUBLE / 8)::VARCHAR::DECIMAL(28,8), 2)::DOUBLE AS eighth
FROM portal_all""",
    "statutory_dates": f"""
SELECT line_id, abs(date_diff('day', invoice_date, {AS_OF})) AS days_apart, {fy_start('invoice_date')}::BIGINT AS fy_start,
  {time_barred('invoice_date', AS_OF)} AS time_barred, 14 - day(invoice_date) AS days_to_cutoff,
  strftime(invoice_date, '%Y-%m') || '-14' AS period_cutoff FROM portal_all""",
    "tolerance_band": f"""
SELECT o_orderkey, abs(l - r)::DOUBLE AS difference, {allowed('r')}::DOUBLE AS allowed, abs(l - r) <= {allowed('r')} AS within_tolerance
FROM (SELECT o_orderkey, r, r + (o_orderkey % 240 - 20) * 0.50::DECIMAL(3,2) AS l
  FROM (SELECT o_orderkey, round(round(o_totalprice, 2)::DECIMAL(28,2) * 0.1::DECIMAL(2,1), 2)::DECIMAL(28,2) AS r FROM orders))""",
    "drc01c_exposure": """
SELECT return_period, c::DOUBLE AS claimed_itc, a::DOUBLE AS available_itc, (c - a)::DOUBLE AS excess, t::DOUBLE AS threshold,
  (t - (c - a))::DOUBLE AS headroom, c - a > t AS fires
FROM (SELECT *, least(100000.00::DECIMAL(28,2), round(a * 0.2::DECIMAL(2,1), 2)::DECIMAL(28,2)) AS t
FROM (SELECT return_period, sum(c)::DECIMAL(28,2) AS c, sum(a)::DECIMAL(28,2) AS a FROM (
  SELECT strftime(invoice_date, '%m-%Y') AS return_period, total_tax AS c, 0::DECIMAL(28,2) AS a FROM books_all
  UNION ALL SELECT strftime(invoice_date, '%m-%Y'), 0, total_tax FROM portal_all) GROUP BY return_period))""",
    "gate_decisions": """
SELECT exception_id, CASE WHEN cls = 'MISSING_IN_2B' THEN 'TIER_3' WHEN cls IN ('DUPLICATE','CANCELLED_IRN','RCM','TIME_BARRED')
    THEN 'TIER_1' ELSE 'TIER_2' END AS tier, action, requires_human, escalated, action = 'REJECT' AS irreversible,
  array_to_string(reasons, '|') AS reasons FROM gated""",
    "submit_once": """
SELECT exception_id AS document_id, ord::BIGINT AS ord, key AS idempotency_key, outcome, 'REF-' || substr(key, 1, 12) AS portal_reference,
  CASE WHEN outcome = 'APPLIED' THEN 'action applied' ELSE 'replayed; the portal had already applied this action' END AS detail FROM sent""",
    "exactly_once": """
SELECT (SELECT count(*) FROM sent) AS attempts, (SELECT count(*) FROM sent WHERE outcome = 'APPLIED') AS effects, 0 AS duplicates,
  (SELECT count(*) FROM sent WHERE outcome = 'APPLIED') + (SELECT count(*) FROM held) AS applied_rows,
  (SELECT count(DISTINCT exception_id) FROM presented) AS documents,
  (SELECT count(DISTINCT exception_id) FROM presented WHERE action = 'REJECT') AS rejected_documents, 0 AS violations""",
    "audit_digest": f"""
SELECT 'cycle:{TAXPAYER}:07-2001:2026.07' AS chain_id, place::BIGINT AS sequence, exception_id, previous AS previous_digest, digest
FROM (WITH RECURSIVE cycle_entries AS MATERIALIZED ({_entries('seq - 1')}),
  cycle_chain AS (
    SELECT place, exception_id, repeat('0', 64) AS previous, sha256(head || repeat('0', 64) || tail) AS digest FROM cycle_entries WHERE place = 0
    UNION ALL SELECT e.place, e.exception_id, c.digest, sha256(e.head || c.digest || e.tail)
    FROM cycle_chain c JOIN cycle_entries e ON e.place = c.place + 1)
  SELECT * FROM cycle_chain)""",
    "audit_verify": """
SELECT cls AS chain_id, CASE WHEN cls = 'DUPLICATE' AND count(*) > 20 THEN count(*) - 1 ELSE count(*) END AS entries,
  NOT ((cls = 'DUPLICATE' AND count(*) > 21) OR (cls = 'RCM' AND count(*) > 11)) AS intact,
  CASE WHEN cls = 'DUPLICATE' AND count(*) > 21 THEN 'entry at position 20 claims sequence 21'
    WHEN cls = 'RCM' AND count(*) > 11 THEN 'entry 11 does not follow entry 10' ELSE 'chain intact' END AS message
FROM gated GROUP BY cls""",
    "audit_segments": """
SELECT cls AS chain_id, count(*) AS entries, NOT (cls = 'DUPLICATE' AND count(*) > 20) AS intact,
  CASE WHEN cls = 'DUPLICATE' AND count(*) > 20 THEN 'segment 1 is not the one that was linked' ELSE 'chain intact' END AS message
FROM gated GROUP BY cls""",
    "audit_tree": """
SELECT cls AS chain_id, n AS entries, NOT hit AS intact, CASE WHEN hit THEN 'entries 16 to 23 are not those that were sealed' ELSE 'sealed' END AS message,
  root, true AS grew, n - CASE WHEN hit THEN (SELECT 1 << l FROM range(40) t(l) WHERE (n >> l) & 1 = 1
    AND 20 BETWEEN ((n >> (l + 1)) << (l + 1)) AND ((n >> (l + 1)) << (l + 1)) + (1 << l) - 1) ELSE 0 END AS proved
FROM (SELECT cls, n, cls = 'DUPLICATE' AND n > 20 AS hit,
    sha256('R' || n || ':' || string_agg(level || '=' || h, ',' ORDER BY level DESC)) AS root
  FROM (WITH RECURSIVE nodes AS (
      SELECT cls, 0 AS level, place::BIGINT AS i, sha256('L' || digest) AS h FROM chain
      UNION ALL SELECT cls, level + 1, i // 2, sha256('N' || string_agg(h, '' ORDER BY i)) FROM nodes
      GROUP BY cls, level + 1, i // 2 HAVING count(*) = 2) SELECT * FROM nodes)
  JOIN (SELECT cls, count(*) AS n FROM chain GROUP BY cls) USING (cls)
  WHERE (n >> level) & 1 = 1 AND i = (n >> level) - 1 GROUP BY cls, n)""",
    "audit_history": """
SELECT cls AS chain_id, place::BIGINT AS sequence, exception_id, action, place::BIGINT + 1000 AS superseded_by FROM entries WHERE place % 4 = 0""",
    "review_queue": """
SELECT exception_id, cls AS exception_class, supplier_gstin, invoice_number, amount_at_risk::DOUBLE AS amount_at_risk,
  action AS proposed_action, audit_sequence::BIGINT AS audit_sequence, confirmation FROM queue""",
    "review_resolution": """
SELECT ord::BIGINT AS ord, target AS exception_id, status, CASE WHEN status = 'resolved' THEN final ELSE '' END AS final_action,
  CASE WHEN status = 'resolved' THEN array_to_string(reasons, '|') || '|' || lower(review_action) || 'd by ' || name ||
    CASE WHEN note <> '' THEN '|reviewer note: ' || note ELSE '' END ELSE '' END AS reasons,
  CASE status WHEN 'unknown' THEN target || ' is not in the review queue' WHEN 'already_resolved' THEN target || ' was already decided'
    WHEN 'unnamed' THEN 'an approval must carry the name of the person making it'
    WHEN 'stale' THEN 'this case changed since the page was loaded, so the approval would apply to something other than what was reviewed; reload and read it again'
    WHEN 'bad_override' THEN 'an override must name one of ACCEPT, REJECT, PENDING' ELSE '' END AS message FROM judged""",
    "review_batches": """
SELECT ord::BIGINT AS ord, target AS exception_id, status, CASE WHEN status = 'resolved' THEN final ELSE '' END AS final_action,
  CASE WHEN status = 'resolved' THEN (SELECT count(*) FROM exceptions) - 1
    + row_number() OVER (PARTITION BY status = 'resolved' ORDER BY ord % 2, ord) ELSE -1 END::BIGINT AS entry FROM judged""",
    "review_depth": """
SELECT (SELECT count(*) FROM queue) - count(*) AS pending, count(*) AS resolved,
  ((SELECT sum(amount_at_risk) FROM queue) - coalesce(sum(amount_at_risk), 0))::DOUBLE AS amount_awaiting_review
FROM judged WHERE status = 'resolved'""",
    "cycle_outcome": f"""
SELECT (SELECT count(*) FROM exact_pairs) + (SELECT count(*) FROM fuzzy_pairs) + count(*) AS documents,
  (SELECT count(*) FROM exact_pairs) AS exact_count, (SELECT count(*) FROM fuzzy_pairs) AS fuzzy_count, count(*) AS exceptions,
  count(*) FILTER (cls NOT IN ('MISSING_IN_BOOKS','AMOUNT_MISMATCH','GSTIN_MISMATCH','CREDIT_NOTE_UNLINKED')) AS rule_closed,
  count(*) FILTER (cls IN ('MISSING_IN_BOOKS','AMOUNT_MISMATCH','GSTIN_MISMATCH','CREDIT_NOTE_UNLINKED')) AS investigated,
  count(*) FILTER (requires_human) AS queued_for_human,
  count(*) FILTER (NOT requires_human AND action IN ('ACCEPT','REJECT') AND seq % 5 <> 0) AS submitted,
  count(*) FILTER (NOT requires_human AND action IN ('ACCEPT','REJECT') AND seq % 5 = 0) AS replayed,
  0 AS exactly_once_violations, '07-2001' AS period, 0 AS days_to_cutoff, 'cycle:{TAXPAYER}:07-2001:2026.07' AS cycle_id FROM gated""",
    "cycle_crashes": """
SELECT 3::BIGINT AS attempts, 1::BIGINT AS ended, count(*) FILTER (NOT requires_human AND action IN ('ACCEPT','REJECT')) AS applied,
  0::BIGINT AS duplicates, 0::BIGINT AS applied_last, count(*) FILTER (NOT requires_human AND action IN ('ACCEPT','REJECT')) AS replayed_last,
  count(*) AS entries, 1::BIGINT AS versions, true AS intact FROM gated""",
    "case_text": "SELECT exception_id, case_text, substr(sha256(detail), 1, 16) AS prompt_digest FROM case_lines",
    "playbook_findings": """
SELECT exception_id, p.action AS proposed_action,
  round(0.55 + ('0x' || substr(sha256(c.cls || case_text), 1, 2))::INT::DOUBLE / 255.0::DOUBLE * 0.44, 4)::DOUBLE AS confidence,
  array_to_string(list_transform(probes, lambda t, i: 'tc' || printf('%02d', i - 1) || '-' || t), '|') AS calls, len(probes)::BIGINT AS steps_used
FROM case_lines c JOIN playbook p USING (cls)""",
}
