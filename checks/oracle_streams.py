"""Oracles for the streams: what they must have left behind."""

from checks.oracle_evaluation import EXTRA as _EVALUATION

_MIX = (("MISSING_IN_2B", 74), ("MISSING_IN_BOOKS", 34), ("AMOUNT_MISMATCH", 26), ("GSTIN_MISMATCH", 16), ("DUPLICATE", 18),
        ("CANCELLED_IRN", 12), ("CREDIT_NOTE_UNLINKED", 10), ("RCM", 6), ("TIME_BARRED", 4))


def _planted():
    edge, cases = 1920, []
    for name, count in _MIX:
        edge += count
        cases.append(f"WHEN slot < {edge} THEN '{name}'")
    return (
        "CASE WHEN slot < 1800 THEN 'EXACT' WHEN slot < 1920 THEN 'FUZZY' " + " ".join(cases) + " END"
    )


SQL = {
    # A duplicate's first copy also matches its book entry exactly.
    "generate_cycle": f"""
SELECT exception_class, count(*) AS documents, count(*) AS as_planted FROM (
  SELECT {_planted()} AS exception_class FROM (SELECT o_orderkey % 2120 AS slot FROM orders)
  UNION ALL SELECT 'EXACT' FROM orders WHERE o_orderkey % 2120 BETWEEN 2070 AND 2087) GROUP BY exception_class""",
    "stream_submit": """
SELECT exception_id AS document_id, action, key AS idempotency_key, 1::BIGINT AS applied_rows FROM presented GROUP BY ALL""",
    "stream_depth": """
SELECT (SELECT count(*) FROM queue) - count(*) AS pending, count(*) AS resolved,
  ((SELECT sum(amount_at_risk) FROM queue) - coalesce(sum(amount_at_risk), 0))::DOUBLE AS amount_awaiting_review
FROM judged WHERE status = 'resolved'""",
    "stream_recovery": """
SELECT 'E' || printf('%05d', conv_id) AS exception_id, turn AS ord, kind AS reply_kind, action, human AS requires_human, reason, stage, sent::BIGINT AS sent FROM run WHERE turn >= 0""",
}

_STEP = """CASE WHEN sent0 >= 2 THEN '{blocked}' WHEN NOT met THEN '{first}' WHEN kind IN ('CLAIMS_FILED','WILL_FILE') THEN {waiting}
  WHEN kind = 'REQUESTS_DOCUMENTS' THEN '{documents}' WHEN kind LIKE 'DISPUTES%' THEN '{dispute}'
  WHEN kind = 'NO_REPLY' THEN {silent} ELSE '{other}' END"""
_ACTION = _STEP.format(blocked="blocked", first="send", waiting="'wait'", documents="send", dispute="escalate",
                       silent="CASE WHEN cycle >= 2 THEN 'escalate' ELSE 'wait' END", other="escalate")
_REASON = _STEP.format(
    blocked="per-vendor message cap reached for this cycle", first="first contact with this vendor requires human approval",
    waiting="CASE kind WHEN 'CLAIMS_FILED' THEN 'supplier claims the return is filed; verify against the next 2B' ELSE 'supplier undertook to file; recheck next cycle' END",
    documents="supplier asked for documents; assemble and send", dispute="supplier disputes the claim; a human owns this conversation",
    silent="CASE WHEN cycle >= 2 THEN 'no reply after two cycles; escalate tone with approval' ELSE 'no reply yet; wait one more cycle' END",
    other="reply could not be classified; hand to a human")

EXTRA = {
    "messages_in": """
  SELECT conv_id, turn, (turn // 3)::BIGINT AS cycle, conv_id % 4 <> 0 OR turn > 1 AS contacted,
    lower(CASE WHEN conv_id % 3 = 0 THEN text || ' Please send a copy.' ELSE text END) AS l FROM conversations""",
    "message_kinds": _EVALUATION["kinds"].replace("(SELECT *, lower(t) AS l FROM replies_in)", "(SELECT *, l AS t FROM messages_in)"),
    "run": f"""
  SELECT conv_id, -1::BIGINT AS turn, 'DRAFTED' AS stage, 0::BIGINT AS cycle, 0::BIGINT AS sent, FALSE AS met, '' AS kind, '' AS action, FALSE AS human, '' AS reason
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, turn, CASE action WHEN 'send' THEN CASE WHEN met THEN 'AWAITING_REPLY' ELSE 'AWAITING_APPROVAL' END WHEN 'escalate' THEN 'ESCALATED'
      WHEN 'wait' THEN 'VERIFYING_NEXT_2B' ELSE stage END, cycle, sent0 + CASE WHEN action = 'send' AND met THEN 1 ELSE 0 END, met, kind, action,
    action = 'escalate' OR (action = 'send' AND NOT met), reason
  FROM (SELECT *, {_ACTION} AS action, {_REASON} AS reason FROM (
    SELECT m.conv_id, m.turn, r.stage, greatest(m.cycle, r.cycle) AS cycle, CASE WHEN m.cycle > r.cycle THEN 0 ELSE r.sent END AS sent0,
      r.met OR m.contacted AS met, m.kind FROM run r JOIN message_kinds m ON m.conv_id = r.conv_id AND m.turn = r.turn + 1))""",
}
