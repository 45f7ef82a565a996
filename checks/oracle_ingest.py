"""Oracles for register ingestion: expectations follow from how the cells were written."""

EXTRA = {
    "sheet": """
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) + 1 AS row_number, 'register-' || s AS source,
    CASE WHEN k % 43 = 0 AND s <> 3 THEN CASE WHEN s = 1 THEN '02/31/1998' ELSE '31/02/1998' END WHEN s = 3 THEN strftime(date_trunc('month', day)::DATE + (day(day)::INT - 1) % 12, '%d/%m/%Y') WHEN s = 1 THEN strftime(day, '%m/%d/%Y') WHEN s = 2 THEN day::VARCHAR
      WHEN s = 5 THEN day(day) || '.' || month(day) || '.' || strftime(day, '%y') ELSE strftime(day, '%d/%m/%Y') END AS date_text
  FROM (SELECT *, c % 7 AS s FROM docs)""",
    "read_rows": """
  SELECT *, CASE WHEN k % 31 = 0 THEN 'supplier GSTIN is blank' WHEN k % 53 = 0 THEN '''n/a'' is not an amount'
    WHEN k % 37 = 0 AND NOT interstate AND half > 0 THEN 'both intra-state and inter-state tax are populated, which no single document carries -- the row is describing two supplies or the wrong columns'
    WHEN k % 43 = 0 THEN '''' || date_text || ''' is not a real date'
    WHEN k % 41 = 0 THEN '''maybe'' is neither yes nor no' END AS reason
  FROM sheet WHERE s IN (0, 1, 2, 5) AND k % 47 <> 0""",
    "evidence": """
  SELECT s, source, min_by(date_text, row_number) FILTER (shown AND TRY_CAST(regexp_extract(date_text, '^([0-9]+)[/.]', 1) AS INT) > 12) AS d,
    min_by(date_text, row_number) FILTER (shown AND TRY_CAST(regexp_extract(date_text, '^[0-9]+[/.]([0-9]+)[/.]', 1) AS INT) > 12) AS m
  FROM (SELECT *, k % 47 <> 0 AS shown FROM sheet) GROUP BY s, source""",
    "orders_read": """
  SELECT s, source, CASE WHEN d IS NOT NULL AND m IS NOT NULL THEN 'UNRESOLVED' WHEN d IS NOT NULL THEN 'DAY_FIRST' WHEN m IS NOT NULL THEN 'MONTH_FIRST' ELSE 'UNRESOLVED' END AS date_order,
    CASE WHEN d IS NOT NULL AND m IS NOT NULL THEN d || ' needs day-first, ' || m || ' needs month-first' ELSE coalesce(d, m, '') END AS evidence FROM evidence""",
}

EXTRA["filed"] = """
  SELECT * EXCLUDE (source, row_number, n), 'register-' || s || '/' || printf('%05d', (row_number - 2) % n) || CASE WHEN s % 2 = 0 THEN '.xlsx' ELSE '.csv' END AS source,
    (row_number - 2) // n + 2 AS row_number
  FROM (SELECT *, ceil(count(*) OVER (PARTITION BY s) / 100000.0)::BIGINT AS n FROM sheet)"""
"""The same registers dealt over files, each read on its own."""

EXTRA["filed_rows"] = EXTRA["read_rows"].replace("FROM sheet", "FROM filed")
EXTRA["filed_evidence"] = EXTRA["evidence"].replace("FROM sheet", "FROM filed")
EXTRA["filed_orders"] = EXTRA["orders_read"].replace("FROM evidence", "FROM filed_evidence")

SQL = {
    "ingest_headers": """
SELECT DISTINCT source, CASE WHEN s = 4 THEN 'cgst|igst|invoice_date|invoice_number|reverse_charge|taxable'
    ELSE 'cgst|igst|invoice_date|invoice_number|reverse_charge|sgst|supplier_gstin|taxable' END AS fields,
  CASE WHEN s IN (0, 2, 6) THEN 'Remarks' ELSE '' END AS unrecognised, CASE WHEN s = 4 THEN 1 ELSE 0 END::BIGINT AS problems FROM sheet""",
    "ingest_amounts": """
SELECT k, CASE k % 9 WHEN 3 THEN -taxable WHEN 4 THEN -taxable WHEN 7 THEN -1 WHEN 8 THEN 0.50 ELSE taxable END::DOUBLE AS amount,
  CASE k % 9 WHEN 3 THEN -taxable WHEN 4 THEN -taxable WHEN 7 THEN -1 WHEN 8 THEN 500 ELSE taxable END::DOUBLE AS strict_amount,
  CASE WHEN k % 9 = 7 THEN '''n/a'' is not an amount' ELSE '' END AS problem FROM docs""",
    "ingest_dates": "SELECT source, date_order, evidence FROM orders_read",
    "ingest_lines": """
SELECT source, source || '#' || printf('R%05d', row_number) AS line_id, gstin AS supplier_gstin, number AS invoice_number,
  CASE s WHEN 5 THEN replace(day::VARCHAR, '199', '209') ELSE day::VARCHAR END AS invoice_date, taxable::DOUBLE AS taxable,
  CASE WHEN interstate THEN tax WHEN k % 37 = 0 THEN half ELSE 0 END::DOUBLE AS igst, k % 5 = 0 AS reverse_charge
FROM read_rows WHERE reason IS NULL""",
    "ingest_rejected": "SELECT source, row_number::BIGINT AS row, reason FROM read_rows WHERE reason IS NOT NULL",
    "ingest_report": """
SELECT source, refused, seen AS rows_seen, rejected, CASE WHEN refused THEN '' ELSE (seen - rejected) || ' of ' || seen || ' rows loaded from ' || source ||
  CASE WHEN rejected > 0 THEN '; ' || rejected || ' rejected' ELSE '' END || CASE WHEN s IN (0, 2) THEN '; columns ignored as unrecognised: Remarks' ELSE '' END ||
  CASE WHEN evidence <> '' THEN '; dates read ' || lower(date_order) || ' (' || evidence || ')' ELSE '' END END AS summary
FROM (SELECT o.*, s IN (3, 4, 6) AS refused, coalesce(r.seen, 0) AS seen, coalesce(r.rejected, 0) AS rejected FROM orders_read o
  LEFT JOIN (SELECT s, count(*) AS seen, count(*) FILTER (reason IS NOT NULL) AS rejected FROM read_rows GROUP BY s) r USING (s))""",
}

SQL["register_files"] = SQL["ingest_lines"].replace("FROM read_rows", "FROM filed_rows")
SQL["register_files_report"] = (
    SQL["ingest_report"].replace("FROM orders_read o", "FROM filed_orders o")
    .replace("SELECT s, count(*) AS seen", "SELECT s, source, count(*) AS seen").replace("FROM read_rows GROUP BY s)", "FROM filed_rows GROUP BY s, source)")
    .replace("USING (s)", "USING (s, source)")
)
