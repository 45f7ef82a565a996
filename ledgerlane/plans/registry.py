"""All registered queries by name."""

from ledgerlane.plans import (
    decision_queries,
    evaluation_queries,
    evidence_queries,
    ingest_queries,
    layout_queries,
    ledger_queries,
    stream_queries,
)

QUERIES = {
    **ledger_queries.QUERIES,
    **decision_queries.QUERIES,
    **evidence_queries.QUERIES,
    **evaluation_queries.QUERIES,
    **ingest_queries.QUERIES,
    **layout_queries.QUERIES,
    **stream_queries.QUERIES,
}
