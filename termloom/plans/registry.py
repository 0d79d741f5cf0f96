"""Named queries over the tables of a folder, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Common parts of the SQL: the latest delivery, the nodes of the ontology, and what follows from them.
def with_parts(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} "


def latest_part(name: str, source: str, key: str, order: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) AS r_ FROM {source} WHERE {key} IS NOT NULL) WHERE r_ = 1)"


SAMPLES = latest_part("s", "samples", "sample_id", "loaded_at")
REQUESTS = latest_part("q", "requests", "req_id", "loaded_at")
HINTS = latest_part("h", "hints", "hint_id", "logged_at")


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\pZ\x{{85}}]+|[\s\pZ\x{{85}}]+$', '', 'g')"


def sql_id(c: str) -> str:
    return f"nullif(upper({sql_strip(f"replace({c}, '_', ':')")}), '')"


def sql_polarity(c: str) -> str:
    words = f"lower({sql_strip(c)})"
    return f"CASE WHEN {words} IN ('present', 'pos', 'positive', 'yes', 'y') THEN 'present' WHEN {words} IN ('absent', 'neg', 'negative', 'no', 'n', 'denied', 'without', 'not_present') THEN 'absent' ELSE 'uncertain' END"


def sql_norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[\s\pZ\x{{85}}]+', ' ', 'g'))"


def sql_ids(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: {sql_id('x')}), lambda x: x IS NOT NULL))"


SQL_SYNONYMS = "list_filter(coalesce(hpo_synonyms, []), lambda x: trim(x) <> '')"
NODES = f"n AS (SELECT {sql_id('hpo_id')} AS id, hpo_name AS name, list_filter({SQL_SYNONYMS}, lambda x, i: list_position({SQL_SYNONYMS}, x) = i) AS synonyms, hpo_def AS definition, {sql_ids('alt_ids')} AS alt_ids, {sql_ids('father')} AS parents, {sql_ids('child')} AS children FROM concepts WHERE hpo_id IS NOT NULL)"
ALIASES = "al AS (SELECT alias, min(id) AS id FROM (SELECT unnest(alt_ids) AS alias, id FROM n) WHERE alias NOT IN (SELECT id FROM n) GROUP BY alias)"
RESOLVER = "rs AS (SELECT id AS any_id, id FROM n UNION ALL SELECT alias, id FROM al)"
EDGES = "e AS (SELECT DISTINCT a.id AS parent, b.id AS child FROM (SELECT id AS p, unnest(children) AS c FROM n UNION SELECT unnest(parents), id FROM n) x JOIN rs a ON a.any_id = x.p JOIN rs b ON b.any_id = x.c WHERE a.id <> b.id)"
CLOSURE = "w AS (SELECT parent AS ancestor, child AS descendant, 1 AS steps FROM e UNION SELECT w.ancestor, e.child, w.steps + 1 FROM w JOIN e ON w.descendant = e.parent WHERE w.steps < (SELECT count(*) FROM n)), cl AS (SELECT ancestor, descendant, min(steps) AS steps FROM w GROUP BY ALL)"
DEPTHS = "d AS (SELECT n.id, CAST(coalesce(min(cl.steps), 0) AS INTEGER) AS depth FROM n LEFT JOIN cl ON cl.descendant = n.id AND cl.ancestor NOT IN (SELECT descendant FROM cl) GROUP BY n.id)"
ONTOLOGY = (NODES, ALIASES, RESOLVER, EDGES, CLOSURE, DEPTHS)
LEXICON = f"lx AS (SELECT DISTINCT term, id FROM (SELECT {sql_norm('t')} AS term, id FROM (SELECT unnest(list_append(synonyms, name)) AS t, id FROM n)) WHERE term <> '')"
