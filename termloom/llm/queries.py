"""Queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from termloom.llm import canonical, lookalike, mixing, overlap, packing, sentences, spans, splitting


def queries() -> dict:
    return {
        "p1_found": canonical.found,
        "p1_report": canonical.report,
        "p2_found": sentences.found,
        "p3_found": splitting.found,
        "p3_pieces": splitting.pieces,
        "p4_found": overlap.found,
        "p4_links": overlap.links,
        "p4_report": overlap.report,
        "p5_found": lookalike.disguised,
        "p5_forms": lookalike.forms,
        "p6_containers": packing.containers,
        "p6_report": packing.report,
        "p7_mixture": mixing.mixture,
        "p7_shares": mixing.shares,
        "p8_found": spans.found,
        "p8_shares": spans.shares,
    }


def _oversized(table: str, key: str, column: str, order: str) -> str:
    limit = f"(SELECT size FROM size_limits WHERE field = '{table}.{column}' AND purpose = 'cut')"
    run = f"list_max(list_transform(regexp_split_to_array({column}, '[\\s\\pZ\\x{{85}}\\p{{P}}]+'), lambda x: length(x)))"
    return f"SELECT '{table}.{column}' AS field, {key} AS item_id, CAST({run} > {limit} AS INTEGER) AS forced FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) AS r_ FROM {table} WHERE {key} IS NOT NULL) WHERE r_ = 1 AND length({column}) > {limit}"


SHARED = (
    "WITH z AS (SELECT size FROM size_limits WHERE field = 'documents.text' AND purpose = 'shared'), w AS (SELECT doc_id, i, substring(text, CAST(i + 1 AS INTEGER), size) AS s FROM (SELECT doc_id, text, size, unnest(range(0, length(text) - size + 1)) AS i FROM documents, z WHERE length(text) >= size), (SELECT 1)), "
    "m AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)), c AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM m)), "
    "g AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + (SELECT size FROM z) THEN 0 ELSE 1 END AS n FROM c)), "
    "f AS (SELECT doc_id, CAST(min(i) AS INTEGER) AS c0, CAST(max(i) + (SELECT size FROM z) AS INTEGER) AS c1 FROM g GROUP BY doc_id, k) "
)


def oracle_sql() -> dict[str, str]:
    """Problems 1, 2 and 4 to 7 have no SQL: they are tested against brute force on fixtures instead."""
    return {
        "p3_found": _oversized("requests", "req_id", "src", "loaded_at") + " UNION ALL " + _oversized("samples", "sample_id", "context", "loaded_at"),
        "p8_found": SHARED + "SELECT doc_id, c0, c1 FROM f",
        "p8_shares": SHARED + "SELECT d.doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, CAST(coalesce(s.s, 0) AS BIGINT) AS shared_chars, round(CASE WHEN length(text) > 0 THEN coalesce(s.s, 0) / length(text) ELSE 0 END, 6) AS shared_part FROM documents d LEFT JOIN (SELECT doc_id, sum(c1 - c0) AS s FROM f GROUP BY doc_id) s USING (doc_id)",
    }
