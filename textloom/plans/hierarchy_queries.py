"""Queries on parent-child links of entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import hierarchy as H
from textloom.plans.registry import query
from textloom.session import materialize, table

_WALK = r"""
WITH RECURSIVE n AS (
  SELECT id, max(type = 'submission') AS terminal,
         CASE WHEN max(type = 'submission') THEN NULL ELSE nullif(regexp_replace(trim(min(parent_id)), '^[tT][13]_', ''), '') END AS parent
  FROM entries WHERE id IS NOT NULL GROUP BY id),
w AS (
  SELECT id, id AS cur, [id] AS seen FROM n
  UNION ALL
  SELECT w.id, p.id, list_append(w.seen, p.id) FROM w JOIN n a ON a.id = w.cur JOIN n p ON p.id = a.parent WHERE NOT list_contains(w.seen, p.id)),
l AS (SELECT id, arg_max(cur, len(seen)) AS last, arg_max(seen, len(seen)) AS seen FROM w GROUP BY id),
r AS (
  SELECT l.id, l.seen, l.last, a.terminal, list_position(l.seen, p.id) AS loop_at
  FROM l JOIN n a ON a.id = l.last LEFT JOIN n p ON p.id = a.parent),
h AS (
  SELECT id,
    CASE WHEN loop_at IS NOT NULL THEN list_min(list_slice(seen, loop_at, len(seen))) ELSE last END AS root_id,
    CASE WHEN loop_at IS NOT NULL THEN loop_at - 1 ELSE len(seen) - 1 END AS depth,
    CASE WHEN loop_at IS NOT NULL THEN 'cycle' WHEN terminal THEN 'tree' ELSE 'orphan' END AS state,
    CASE WHEN loop_at IS NOT NULL THEN list_reverse(list_slice(seen, 1, loop_at)) ELSE list_reverse(seen) END AS path
  FROM r)
"""


@query("p7_found", _WALK + "SELECT id, root_id, CAST(depth AS BIGINT) AS depth, CASE WHEN state = 'tree' THEN 'deep' ELSE state END AS state FROM h WHERE state <> 'tree' OR depth >= 10")
def p7_found(spark, sf_dir):
    return H.special_entries(table(spark, sf_dir, "entries"))


@query(
    "p7_hierarchy",
    _WALK + """, d AS (SELECT u AS id, count(*) AS descendants FROM (SELECT unnest(path[:len(path) - 1]) AS u FROM h) GROUP BY u)
SELECT h.id, root_id, CAST(depth AS BIGINT) AS depth, state, array_to_string(path, '/') AS path, CAST(coalesce(descendants, 0) AS BIGINT) AS descendants
FROM h LEFT JOIN d ON d.id = h.id""",
)
def p7_hierarchy(spark, sf_dir):
    h = materialize(H.entry_hierarchy(table(spark, sf_dir, "entries")), "hierarchy")
    return h.join(H.descendant_counts(h), "id", "left").select(
        "id", "root_id", "depth", "state", F.concat_ws("/", "path").alias("path"), F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants")
    )


@query("p7_descendants", _WALK + "SELECT path[i] AS id, id AS descendant, CAST(len(path) - i AS BIGINT) AS steps FROM (SELECT id, path, unnest(range(1, len(path))) AS i FROM h)")
def p7_descendants(spark, sf_dir):
    return H.descendants(H.entry_hierarchy(table(spark, sf_dir, "entries")))
