"""One DuckDB statement per registered query."""

from checks import (
    oracle_decisions,
    oracle_evaluation,
    oracle_evidence,
    oracle_ingest,
    oracle_layout,
    oracle_streams,
)
from checks.oracle_base import with_ctes

MATCH = {
    "exact_match": "SELECT bid AS book_line_id, pid AS portal_line_id FROM exact_pairs",
    "contested_assignment": """
SELECT b.line_id AS book_line_id, p.line_id AS portal_line_id, 2::BIGINT AS days_apart FROM (
  SELECT o_orderpriority AS g, 'L' || printf('%012d', o_orderkey) AS line_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k
  FROM orders WHERE o_custkey % 2 <> 0) b JOIN (
  SELECT o_orderpriority AS g, 'L' || printf('%012d', o_orderkey) AS line_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k
  FROM orders WHERE o_custkey % 2 = 0) p ON b.g = p.g AND b.k = p.k""",
    "fuzzy_candidates": (
        "SELECT bid AS book_line_id, pid AS portal_line_id, affinity, delta::DOUBLE AS tax_delta, "
        "gap::BIGINT AS days_apart FROM edges"
    ),
    "fuzzy_assignment": (
        "SELECT bid AS book_line_id, pid AS portal_line_id, affinity AS number_similarity, "
        "delta::DOUBLE AS tax_delta, gap::BIGINT AS days_apart, detail FROM fuzzy_pairs"
    ),
    "reverse_charge_pairs": (
        "SELECT coalesce(bid, '') AS book_line_id, coalesce(pid, '') AS portal_line_id, detail FROM staged WHERE stage <= 2"
    ),
    "amount_mismatch": "SELECT bid AS book_line_id, pid AS portal_line_id, detail FROM staged WHERE stage = 3",
    "gstin_mismatch": "SELECT bid AS book_line_id, pid AS portal_line_id, detail, candidates FROM staged WHERE stage = 4",
    "portal_residue": "SELECT pid AS portal_line_id, cls AS exception_class, detail, candidates FROM staged WHERE stage = 5",
    "book_residue": "SELECT bid AS book_line_id, cls AS exception_class, detail FROM staged WHERE stage = 6",
    "reconcile_full": (
        "SELECT exception_id, seq::BIGINT AS seq, cls AS exception_class, coalesce(bid, '') AS book_line_id, "
        "coalesce(pid, '') AS portal_line_id, detail, candidates, supplier_gstin, amount_at_risk::DOUBLE AS amount_at_risk FROM exceptions"
    ),
    "match_summary": """
SELECT d AS documents, e AS exact_count, f AS fuzzy_count, x AS exceptions, round(e / d, 6) AS exact_rate, round(f / d, 6) AS fuzzy_rate
FROM (SELECT e, f, x, e + f + x AS d FROM (SELECT (SELECT count(*) FROM exact_pairs) AS e,
  (SELECT count(*) FROM fuzzy_pairs) AS f, (SELECT count(*) FROM staged) AS x))""",
    "exceptions_by_class": "SELECT cls AS exception_class, count(*) AS exceptions FROM staged GROUP BY cls",
    "conservation": """
SELECT side, times_in, times_out, count(*) AS lines FROM (
  SELECT side, line_id, sum(i)::BIGINT AS times_in, sum(o)::BIGINT AS times_out FROM (
    SELECT 'book' AS side, line_id, 1 AS i, 0 AS o FROM books_all
    UNION ALL SELECT 'portal', line_id, 1, 0 FROM portal_all
    UNION ALL SELECT 'book', bid, 0, 1 FROM exact_pairs UNION ALL SELECT 'portal', pid, 0, 1 FROM exact_pairs
    UNION ALL SELECT 'book', bid, 0, 1 FROM fuzzy_pairs UNION ALL SELECT 'portal', pid, 0, 1 FROM fuzzy_pairs
    UNION ALL SELECT 'book', bid, 0, 1 FROM staged WHERE bid IS NOT NULL
    UNION ALL SELECT 'portal', pid, 0, 1 FROM staged WHERE pid IS NOT NULL AND stage > 2
    UNION ALL SELECT DISTINCT 'portal', pid, 0, 1 FROM staged WHERE pid IS NOT NULL AND stage <= 2)
  GROUP BY side, line_id) GROUP BY side, times_in, times_out""",
}


def oracle_sql():
    out = {name: with_ctes(sql) for name, sql in MATCH.items()}
    for module in MODULES:
        out.update({name: with_ctes(sql, EXTRA) for name, sql in module.SQL.items()})
    return out


MODULES = (oracle_decisions, oracle_evidence, oracle_evaluation, oracle_ingest, oracle_layout, oracle_streams)
EXTRA = {name: text for module in MODULES for name, text in module.EXTRA.items()}
