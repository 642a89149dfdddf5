"""DuckDB SQL twins of the fixture views and of every registered query.

Each oracle is one self-contained statement over the driver's pre-registered tables (fixture views
are CTEs), written independently of the Spark plan: brute-force where that is simpler (e.g. the
contained-tag check is a theta self-join here, an equi anti-join on word runs in Spark)."""

from __future__ import annotations

from tagloom.functions.text import KAOMOJI


def sql_list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def rus(col: str) -> str:
    """SQL twin of ``replace_underscores``."""
    return f"CASE WHEN {col} IN ({sql_list(KAOMOJI)}) THEN {col} ELSE replace({col}, '_', ' ') END"


FIX = {
    "tags_raw": """tags_raw AS (
        SELECT replace(p.p_name, ' ', '_') AS name, CAST(count(l.l_orderkey) AS INTEGER) AS post_count
        FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey
        GROUP BY p.p_partkey, p.p_name)""",
    "wiki_raw": """wiki_raw AS (
        SELECT CAST(d.doc_id AS INTEGER) AS id,
               concat(CASE WHEN d.source = 'src0' THEN 'help:' WHEN d.source = 'src1' THEN 'api:' ELSE '' END,
                      coalesce(replace(p.p_name, ' ', '_'), 'page_' || CAST(d.doc_id AS VARCHAR)),
                      CASE WHEN d.doc_id % 3 = 0 THEN concat('_(', d.source, ')') ELSE '' END) AS title,
               d.text AS body
        FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id)""",
    "tag_groups": """tag_groups AS (
        SELECT DISTINCT replace(p_name, ' ', '_') AS tag, lower(p_type) AS tag_group FROM part)""",
    "label_vocab": """label_vocab AS (
        SELECT r AS idx, concat(CASE WHEN r < 4 THEN 'rating_' ELSE 'tag_' END, CAST(r AS VARCHAR)) AS name,
               CASE WHEN r < 4 THEN 9 WHEN r < 52 THEN 0 ELSE 4 END AS category
        FROM (SELECT DISTINCT t.r FROM embeddings, range(len(embedding)) t(r)) w)""",
    "file_edits": """file_edits AS (
        SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey ELSE -o_orderkey END AS file_id, 'edited, widget' AS previous_edit,
               CASE WHEN o_orderkey % 20 = 0 THEN concat_ws(', ', 'edited', lower(o_orderpriority))
                    ELSE concat_ws(', ', 'edited', lower(o_orderstatus)) END AS new_edit
        FROM orders)""",
    "score_long": """score_long AS (
        SELECT vec_id, i - 1 AS idx, round(1 / (1 + exp(-10 * CAST(embedding[i] AS DOUBLE))), 6) AS score
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) x)""",
    "pred": """pred AS (
        SELECT file_id, category, tag, max(score) AS score FROM (
            SELECT l.l_orderkey AS file_id,
                   CASE WHEN p.p_type = 'PROMO' THEN 'character' ELSE 'general' END AS category,
                   replace(p.p_name, ' ', '_') AS tag, round(l.l_discount * 10, 2) AS score
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
            UNION ALL
            SELECT l.l_orderkey, 'general', split_part(p.p_name, ' ', 2), round(1 - l.l_tax * 10, 2)
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
            UNION ALL
            SELECT l.l_orderkey, 'rating', concat('rating_', lower(l.l_returnflag)), round(l.l_quantity / 50, 2)
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) u
        GROUP BY file_id, category, tag)""",
    "files": """files AS (
        SELECT page_id AS file_id, sha256(html) AS hash, CAST(strlen(html) AS INTEGER) AS n_bytes FROM pages)""",
    "captions": """captions AS (
        SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE -o_orderkey END AS file_id,
               CASE WHEN o_orderkey % 50 = 5 THEN '' ELSE concat_ws(', ', 'edited', lower(o_orderpriority)) END AS caption
        FROM orders)""",
    "cache_log": """cache_log AS (
        SELECT sha256(concat(json_extract_string(props, '$.k'), ':', CAST(user_id AS VARCHAR))) AS hash,
               event_type AS repo_name, CASE WHEN user_id % 11 <> 0 THEN concat('ds', CAST(event_id % 7 AS VARCHAR)) END AS dataset,
               concat_ws('#', props, CAST(event_id AS VARCHAR)) AS data, event_id AS seq
        FROM events)""",
    "history_log": """history_log AS (
        SELECT event_id AS seq, concat('ds', CAST(event_id * event_id % 23 AS VARCHAR)) AS dataset
        FROM events)""",
    "settings_log": """settings_log AS (
        SELECT concat('ds', CAST(user_id % 7 AS VARCHAR)) AS dataset, event_type AS key,
               CAST(value AS VARCHAR) AS value, event_id AS seq FROM events)""",
    "edit_log": """edit_log AS (
        SELECT concat('ds', CAST(event_id % 7 AS VARCHAR)) AS dataset, sha256(CAST(user_id AS VARCHAR)) AS hash,
               event_type AS previous_edit, props AS new_edit, event_id AS seq FROM events)""",
}


def with_(*names: str, extra: str = "") -> str:
    """``WITH`` clause of fixture views (plus query-specific CTEs in ``extra``)."""
    parts = [FIX[n] for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


# Threshold -> trim pipeline over the fixture predictions, shared by several oracles.
def kept_ctes(general: float = 0.35, character: float = 0.9) -> str:
    return f"""p AS MATERIALIZED (SELECT file_id, category, {rus('tag')} AS tag, score, tag AS ord FROM pred),
th AS MATERIALIZED (SELECT * FROM p WHERE (category = 'general' AND score >= {general})
                          OR (category = 'character' AND score >= {character})),
g AS MATERIALIZED (SELECT *, regexp_replace(trim(tag), '\\s+', ' ', 'g') AS k FROM th WHERE category = 'general'),
gt AS (SELECT a.file_id, a.category, a.tag, a.score, a.ord FROM g a WHERE NOT EXISTS (
        SELECT 1 FROM g b WHERE b.file_id = a.file_id AND b.tag <> a.tag
          AND (a.k = '' OR contains(' ' || b.k || ' ', ' ' || a.k || ' '))
          AND (b.k <> a.k OR b.ord < a.ord))),
kept AS (SELECT file_id, category, tag, score, ord FROM th WHERE category = 'character'
         UNION ALL SELECT file_id, category, tag, score, ord FROM gt)"""
