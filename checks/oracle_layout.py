"""Oracles for stored, laid-out tables: the same answers without any layout."""

EXTRA = {
    "period_lines": """
  SELECT *, strftime(invoice_date, '%m-%Y') AS return_period, strftime(invoice_date, '%Y%m') AS month FROM portal_all""",
    "booked_documents": """
  SELECT supplier_gstin, invoice_number, count(*) AS booked, min(line_id) AS first_book, sum(total_tax) AS booked_tax
  FROM books_all GROUP BY supplier_gstin, invoice_number""",
}

SQL = {
    "statement_open": """
SELECT p.line_id, p.return_period, coalesce(b.booked, 0)::BIGINT AS booked, coalesce(b.first_book, '') AS first_book,
  (p.total_tax - coalesce(b.booked_tax, 0))::DOUBLE AS tax_gap
FROM period_lines p LEFT JOIN booked_documents b USING (supplier_gstin, invoice_number)
WHERE month IN (SELECT DISTINCT month FROM period_lines ORDER BY month DESC LIMIT 6)""",
    "precedents_stored": """
SELECT w.id AS precedent_id, 1::BIGINT AS stored, sum(w * w)::BIGINT AS norm_squared,
  CASE right(w.id, 10)::BIGINT % 4 WHEN 1 THEN 'MISSING_IN_BOOKS' WHEN 2 THEN 'AMOUNT_MISMATCH' WHEN 3 THEN 'GSTIN_MISMATCH' ELSE 'CREDIT_NOTE_UNLINKED' END AS exception_class
FROM weights w WHERE side = 'p' GROUP BY w.id""",
}
