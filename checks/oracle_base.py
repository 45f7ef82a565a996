"""DuckDB text shared by the oracles: derived ledger tables and every match stage.

Written with other means than the Spark jobs (list functions, row-number joins, a recursive
walk over ranked pairings), so that agreement says something.
"""

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MONEY = "DECIMAL(28,2)"


def gstin_key(x):
    return f"upper(regexp_replace({x}, '\\s+', '', 'g'))"


def check_char(body):
    v = f"(strpos('{ALPHABET}', substr({body}, i::INT, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)"
    total = f"list_sum(list_transform(range(1, 15), lambda i: ({v}) // 36 + ({v}) % 36))"
    return f"substr('{ALPHABET}', ((36 - ({total}) % 36) % 36 + 1)::INT, 1)"


def number_key(x):
    strip = "CASE WHEN regexp_matches(t, '^[0-9]') THEN coalesce(nullif(ltrim(t, '0'), ''), '0') ELSE t END"
    return f"array_to_string(list_transform(regexp_extract_all(upper({x}), '[A-Z]+|[0-9]+'), lambda t: {strip}), '|')"


def valid_gstin(g):
    pattern = "^[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
    return f"(regexp_matches({g}, '{pattern}') AND {check_char(f'substr({g}, 1, 14)')} = substr({g}, 15, 1))"


def allowed(p):
    return f"greatest(1.00::{MONEY}, least(round(({p}) * 0.005::DECIMAL(6,4), 2)::{MONEY}, 100.00::{MONEY}))"


def fy_start(d):
    return f"(year({d}) - CASE WHEN month({d}) < 4 THEN 1 ELSE 0 END)"


def time_barred(d, as_of):
    return f"({as_of} > make_date({fy_start(d)} + 1, 11, 30))"


AS_OF = "DATE '2001-07-14'"


def gstin_of(c):
    letters = " || ".join(f"chr((65 + ({c} // {26**i}) % 26)::INT)" for i in range(5))
    return (
        f"list_extract(['27','29','07','19','24','33','06','36'], ({c} % 8 + 1)::INT) || {letters} || "
        f"printf('%04d', {c} % 10000) || chr((65 + ({c} * 7) % 26)::INT) || '1Z'"
    )


def _lines(source, rows):
    parts = []
    for where, suffix, gstin, number, day, drift, kind, original in rows:
        parts.append(
            f"SELECT {source}.*, '{suffix}' AS suffix, {gstin} AS supplier_gstin, {number} AS invoice_number, "
            f"{day} AS invoice_date, ({drift})::{MONEY} AS drift, '{kind}' AS kind, {original}::VARCHAR AS original "
            f"FROM {source} WHERE {where}"
        )
    return " UNION ALL ".join(parts)


_SWAP = (
    "CASE WHEN substr(gstin,3,1) <> substr(gstin,4,1) "
    "THEN substr(gstin,1,2) || substr(gstin,4,1) || substr(gstin,3,1) || substr(gstin,5,11) "
    "ELSE substr(gstin,1,6) || substr(gstin,8,1) || substr(gstin,7,1) || substr(gstin,9,7) END"
)
_BOOK_ROWS = [
    ("m NOT IN (1,5,6,14,3)", "", "gstin", "number", "day", "0", "INVOICE", "NULL"),
    ("m = 3", "", _SWAP, "number", "day", "0", "INVOICE", "NULL"),
    ("m = 11 AND NOT second", "A", "gstin", "number || '-A'", "day", "0", "INVOICE", "NULL"),
    ("m = 11", "B", "gstin", "number || '-A-B'", "day", "0", "INVOICE", "NULL"),
]
_PORTAL_ROWS = [
    ("m NOT IN (0,15,2,6,8,9,10,11)", "", "gstin", "number", "day", "0", "INVOICE", "NULL"),
    ("m = 2", "", "gstin", "number", "day", "250 + k % 3750", "INVOICE", "NULL"),
    ("m = 4", "D", "gstin", "replace(number, '/', '-')", "day", "0", "INVOICE", "NULL"),
    ("m = 6", "", "gstin", "'CN/' || number", "day", "0", "CREDIT_NOTE", "CASE WHEN second THEN NULL ELSE number END"),
    ("m = 8", "", "gstin", "number", "day", "0.37", "INVOICE", "NULL"),
    ("m = 9", "", "gstin", "number || '-A'", "day + 3", "0", "INVOICE", "NULL"),
    ("m = 10", "", "gstin", "number", "day + 45", "0.50", "INVOICE", "NULL"),
    ("m = 11 AND second", "", "gstin", "number", "day", "0.95", "INVOICE", "NULL"),
    ("m = 11 AND second", "B", "gstin", "number || '-A'", "day + 2", "0.10", "INVOICE", "NULL"),
    ("m = 11 AND NOT second", "", "gstin", "number", "day", "0.30", "INVOICE", "NULL"),
    ("m = 11", "A", "gstin", "number || '-A'", "day", "0.10", "INVOICE", "NULL"),
    ("m = 11 AND NOT second", "B", "gstin", "number || '-A-B'", "day", "0.20", "INVOICE", "NULL"),
    ("m = 13", "C", "gstin", "'CN/' || number", "day", "0", "CREDIT_NOTE", "number"),
]


def _side(prefix, rcm, status):
    zero = f"0::{MONEY}"
    return f"""
  SELECT *, (cgst + sgst + igst + cess)::{MONEY} AS total_tax,
    {gstin_key('supplier_gstin')} AS g, {number_key('invoice_number')} AS n
  FROM (SELECT '{prefix}' || id || suffix AS line_id, supplier_gstin, invoice_number, invoice_date, taxable,
    CASE WHEN interstate THEN {zero} ELSE (tax - half + drift)::{MONEY} END AS cgst,
    CASE WHEN interstate THEN {zero} ELSE half END AS sgst,
    CASE WHEN interstate THEN (tax + drift)::{MONEY} ELSE {zero} END AS igst, {zero} AS cess,
    kind, m IN ({rcm}) AS rcm, irn, {status} AS irn_status, original AS original_invoice_number, k, c, m, second
  FROM {prefix}_lines)"""


_STATUS = "CASE WHEN m = 5 THEN 'CANCELLED' WHEN irn IS NULL THEN 'NOT_APPLICABLE' ELSE 'ACTIVE' END"

CTES = {
    "docs": f"""
  SELECT *, round(tax * 0.5::DECIMAL(2,1), 2)::{MONEY} AS half, substr(gstin, 1, 2) <> '27' AS interstate,
    CASE WHEN m IN (6,7,14,15) THEN NULL ELSE 'IRN' || printf('%012d', k) END AS irn
  FROM (SELECT *, body || {check_char('body')} AS gstin, round(taxable * rate, 2)::{MONEY} AS tax
  FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 40 AS m, (o_orderkey % 80) >= 40 AS second,
    printf('%010d', o_orderkey) AS id, {gstin_of('o_custkey')} AS body,
    CASE o_custkey % 4 WHEN 0 THEN 'INV/' || year(o_orderdate) || '/' || printf('%04d', o_orderkey)
      WHEN 1 THEN 'INV-' || year(o_orderdate) || '-' || o_orderkey
      WHEN 2 THEN year(o_orderdate) || printf('%05d', o_orderkey)
      ELSE 'INV' || printf('%05d', o_orderkey) END AS number,
    o_orderdate::DATE AS day, round(o_totalprice, 2)::{MONEY} AS taxable,
    CASE o_orderkey % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.12 WHEN 2 THEN 0.18 ELSE 0.28 END::DECIMAL(3,2) AS rate
  FROM orders))""",
    "B_lines": _lines("docs", _BOOK_ROWS),
    "P_lines": _lines("docs", _PORTAL_ROWS),
    "books_all": _side("B", "7,15", "NULL::VARCHAR"),
    "portal_all": _side("P", "7,14", _STATUS),
    "vendors": f"""
  SELECT body || {check_char('body')} AS gstin, c_name AS legal_name, c_custkey % 10 < 3 AS files_late,
    CASE WHEN c_custkey % 25 < 2 THEN 'REPEATED_LATE_FILING' END AS risk_flag
  FROM (SELECT *, {gstin_of('c_custkey')} AS body FROM customer)""",
    "bank": f"""
  SELECT 'BP' || id AS payment_id, gstin AS counterparty_gstin,
    (taxable + tax + (k % 3) * 0.60::DECIMAL(4,2))::{MONEY} AS amount,
    day + (k % 40 + 5)::INT AS value_date, 'NEFT Customer ' || c AS narration
  FROM docs""",
    "irn_registry": """
  SELECT irn, CASE WHEN m = 5 THEN 'CANCELLED' ELSE 'ACTIVE' END AS status
  FROM docs WHERE irn IS NOT NULL""",
    "prior_portal": f"""
  SELECT 'Q' || id AS line_id, gstin AS supplier_gstin, number AS invoice_number, tax AS total_tax,
    strftime((day - INTERVAL 1 MONTH)::DATE, '%m-%Y') AS return_period, {number_key('number')} AS n
  FROM docs""",
    "books": "SELECT * FROM books_all WHERE NOT rcm",
    "portal": "SELECT * FROM portal_all WHERE NOT rcm",
    # exact pass
    "exact_pairs": """
  SELECT b.line_id AS bid, p.line_id AS pid
  FROM (SELECT *, row_number() OVER (PARTITION BY g, n, total_tax ORDER BY line_id) AS r FROM books) b
  JOIN (SELECT *, row_number() OVER (PARTITION BY g, n, total_tax ORDER BY line_id) AS r FROM portal) p
  USING (g, n, total_tax, r)""",
    "b1": "SELECT * FROM books WHERE line_id NOT IN (SELECT bid FROM exact_pairs)",
    "p1": "SELECT * FROM portal WHERE line_id NOT IN (SELECT pid FROM exact_pairs)",
    # tolerant pass: pairwise theta join, then a walk over the ranked pairings of each group
    "edges": f"""
  SELECT *, row_number() OVER (PARTITION BY g, root ORDER BY affinity DESC, delta, gap, bid, pid) AS i FROM (
    SELECT b.g AS g, regexp_replace(b.n, '(^|\\|)[A-Z]+(\\|[A-Z]+)*$', '') AS root, b.line_id AS bid, p.line_id AS pid,
      CASE WHEN b.n = p.n THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS affinity,
      abs(b.total_tax - p.total_tax)::{MONEY} AS delta,
      abs(date_diff('day', b.invoice_date, p.invoice_date)) AS gap,
      CASE WHEN b.n = p.n THEN NULL WHEN length(b.n) > length(p.n) THEN regexp_extract(b.n, '[A-Z]+$')
        ELSE regexp_extract(p.n, '[A-Z]+$') END AS suffix
    FROM (
      SELECT b, p FROM b1 b JOIN p1 p ON b.g = p.g AND b.n = p.n
      UNION ALL SELECT b, p FROM (SELECT *, regexp_replace(n, '(^|\\|)[A-Z]+$', '') AS up FROM b1 WHERE regexp_matches(n, '(^|\\|)[A-Z]+$')) b
        JOIN p1 p ON b.g = p.g AND b.up = p.n
      UNION ALL SELECT b, p FROM b1 b
        JOIN (SELECT *, regexp_replace(n, '(^|\\|)[A-Z]+$', '') AS up FROM p1 WHERE regexp_matches(n, '(^|\\|)[A-Z]+$')) p ON b.g = p.g AND p.up = b.n)
    WHERE abs(date_diff('day', b.invoice_date, p.invoice_date)) <= 30
      AND abs(b.total_tax - p.total_tax) <= {allowed('p.total_tax')})""",
    "walk": """
  SELECT g, root, 0::BIGINT AS i, []::VARCHAR[] AS ub, []::VARCHAR[] AS up, ''::VARCHAR AS bid, ''::VARCHAR AS pid, FALSE AS taken
  FROM (SELECT DISTINCT g, root FROM edges)
  UNION ALL
  SELECT w.g, w.root, e.i,
    CASE WHEN list_contains(w.ub, e.bid) OR list_contains(w.up, e.pid) THEN w.ub ELSE list_append(w.ub, e.bid) END,
    CASE WHEN list_contains(w.ub, e.bid) OR list_contains(w.up, e.pid) THEN w.up ELSE list_append(w.up, e.pid) END,
    e.bid, e.pid, NOT (list_contains(w.ub, e.bid) OR list_contains(w.up, e.pid))
  FROM walk w JOIN edges e ON e.g = w.g AND e.root = w.root AND e.i = w.i + 1""",
    "fuzzy_pairs": """
  SELECT e.*, CASE WHEN suffix IS NULL THEN 'identical after normalisation'
      ELSE 'house-style suffix ''' || suffix || '''' END || '; dates ' || gap || 'd apart; tax differs by ' || delta AS detail
  FROM walk w JOIN edges e ON e.g = w.g AND e.root = w.root AND e.i = w.i WHERE w.taken""",
    "b2": "SELECT * FROM b1 WHERE line_id NOT IN (SELECT bid FROM fuzzy_pairs)",
    "p2": "SELECT * FROM p1 WHERE line_id NOT IN (SELECT pid FROM fuzzy_pairs)",
    # paired classes
    "amount_pairs": f"""
  SELECT b.line_id AS bid, p.line_id AS pid, abs(b.total_tax - p.total_tax)::{MONEY} AS delta
  FROM (SELECT *, row_number() OVER (PARTITION BY g, n ORDER BY line_id) AS r FROM b2) b
  JOIN (SELECT *, row_number() OVER (PARTITION BY g, n ORDER BY line_id) AS r FROM p2) p USING (g, n, r)""",
    "b3": "SELECT * FROM b2 WHERE line_id NOT IN (SELECT bid FROM amount_pairs)",
    "p3": "SELECT * FROM p2 WHERE line_id NOT IN (SELECT pid FROM amount_pairs)",
    "gstin_pairs": f"""
  SELECT b.line_id AS bid, p.line_id AS pid, b.supplier_gstin AS bg, p.supplier_gstin AS pg
  FROM (SELECT *, row_number() OVER (PARTITION BY n, total_tax ORDER BY line_id) AS r FROM b3 WHERE NOT {valid_gstin('g')}) b
  JOIN (SELECT *, row_number() OVER (PARTITION BY n, total_tax ORDER BY line_id) AS r FROM p3) p USING (n, total_tax, r)""",
    "b4": "SELECT * FROM b3 WHERE line_id NOT IN (SELECT bid FROM gstin_pairs)",
    "p4": "SELECT * FROM p3 WHERE line_id NOT IN (SELECT pid FROM gstin_pairs)",
    # singleton classes
    "consumed": "SELECT g, n, max(line_id) AS cid FROM portal WHERE line_id NOT IN (SELECT line_id FROM p4) GROUP BY g, n",
    "known": "SELECT n FROM books UNION SELECT n FROM portal",
    "portal_residue": f"""
  SELECT *, CASE WHEN cls = 'CANCELLED_IRN' THEN 'IRN ' || coalesce(irn, 'None') || ' is cancelled at the portal but present in 2B'
      WHEN cls = 'DUPLICATE' THEN 'same supplier and invoice number as ' || twin || ', reported twice'
      WHEN cls = 'CREDIT_NOTE_UNLINKED' THEN 'credit note references ' || coalesce('''' || original_invoice_number || '''', 'None') || ', absent from this period'
      ELSE 'present in GSTR-2B with no counterpart in the purchase register' END AS detail
  FROM (SELECT *, CASE WHEN irn_status = 'CANCELLED' THEN 'CANCELLED_IRN' WHEN twin IS NOT NULL THEN 'DUPLICATE'
      WHEN kind = 'CREDIT_NOTE' AND (original_invoice_number IS NULL
        OR {number_key('original_invoice_number')} NOT IN (SELECT n FROM known)) THEN 'CREDIT_NOTE_UNLINKED'
      ELSE 'MISSING_IN_BOOKS' END AS cls
  FROM (SELECT p4.*, coalesce(cid, CASE WHEN row_number() OVER live > 1 AND irn_status <> 'CANCELLED'
      THEN first_value(line_id) OVER live END) AS twin
    FROM p4 LEFT JOIN consumed USING (g, n)
    WINDOW live AS (PARTITION BY g, n, irn_status = 'CANCELLED' ORDER BY line_id)))""",
    "book_residue": f"""
  SELECT *, CASE WHEN {time_barred('invoice_date', AS_OF)} THEN 'TIME_BARRED' ELSE 'MISSING_IN_2B' END AS cls,
    CASE WHEN {time_barred('invoice_date', AS_OF)} THEN 'invoice dated ' || invoice_date::VARCHAR || ' is outside the Section 16(4) window; report only'
      ELSE 'in the purchase register with no counterpart in GSTR-2B' END AS detail
  FROM b4""",
    "rcm_pairs": """
  SELECT b.line_id AS bid, p.pid FROM books_all b
  LEFT JOIN (SELECT g, n, max(line_id) AS pid FROM portal_all WHERE rcm GROUP BY g, n) p USING (g, n) WHERE b.rcm""",
    "staged": """
  SELECT 1 AS stage, bid AS sort_id, 'RCM' AS cls, bid, pid, 'reverse charge supply; credit follows separate treatment' AS detail, '' AS candidates FROM rcm_pairs
  UNION ALL SELECT 2, line_id, 'RCM', NULL, line_id, 'reverse charge supply reported by the supplier only', '' FROM portal_all
    WHERE rcm AND line_id NOT IN (SELECT pid FROM rcm_pairs WHERE pid IS NOT NULL)
  UNION ALL SELECT 3, bid, 'AMOUNT_MISMATCH', bid, pid, 'tax differs by ' || delta || ', beyond configured tolerance', '' FROM amount_pairs
  UNION ALL SELECT 4, bid, 'GSTIN_MISMATCH', bid, pid, 'book GSTIN ' || bg || ' fails checksum; portal reports ' || pg || ' for the same document', pid FROM gstin_pairs
  UNION ALL SELECT 5, line_id, cls, NULL, line_id, detail, CASE WHEN cls = 'DUPLICATE' THEN twin ELSE '' END FROM portal_residue
  UNION ALL SELECT 6, line_id, cls, line_id, NULL, detail, '' FROM book_residue""",
    "exceptions": """
  SELECT 'E' || printf('%05d', seq) || '-' || coalesce(pid, bid) AS exception_id, s.*,
    coalesce(p.supplier_gstin, b.supplier_gstin) AS supplier_gstin, coalesce(p.total_tax, b.total_tax) AS amount_at_risk,
    b.supplier_gstin AS b_gstin, b.invoice_number AS b_number, b.invoice_date AS b_date, b.taxable AS b_taxable, b.total_tax AS b_tax, b.irn AS b_irn,
    p.supplier_gstin AS p_gstin, p.invoice_number AS p_number, p.invoice_date AS p_date, p.taxable AS p_taxable, p.total_tax AS p_tax, p.irn AS p_irn
  FROM (SELECT *, row_number() OVER (ORDER BY stage, sort_id) AS seq FROM staged) s
  LEFT JOIN books_all b ON b.line_id = s.bid LEFT JOIN portal_all p ON p.line_id = s.pid""",
}


def with_ctes(select, extra=None):
    ctes = {**CTES, **(extra or {})}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({b})" for n, b in ctes.items()) + "\n" + select
