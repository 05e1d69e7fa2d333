"""Queries of the core's own problem, with their SQL."""

from __future__ import annotations

from quarry.operators import orphans as O
from quarry.sources.tables import table


def _orphans(spark, d):
    return O.orphans(
        table(spark, d, "imports", "id", "resolved_file_path", "target_package_id", "is_external", "resolution_type", "created_at"),
        table(spark, d, "files", "file_path", "created_at"),
        table(spark, d, "packages", "id", "created_at"),
        table(spark, d, "file_delta", "path", "change", "old_path"),
    )


def p1_found(spark, d):
    return _orphans(spark, d).select("import_id", "ref_field", "state")


def p1_by_month(spark, d):
    return O.orphans_by_period(_orphans(spark, d))


_NORM = r"""ltrim(list_reduce(list_prepend('', list_filter(string_split(replace(trim({0}), '\', '/'), '/'), lambda p: trim(p) NOT IN ('', '.'))),
  lambda a, p: CASE WHEN p = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || p END), '/')"""

_P1 = f"""
WITH refs AS (
  SELECT id, created_at, 'resolved_file_path' AS ref_field, 'files' AS parent_table,
         CASE WHEN trim(resolved_file_path) <> '' THEN {_NORM.format("resolved_file_path")} END AS key,
         coalesce(lower(trim(resolution_type)) IN ('relative', 'alias'), false) AS demanded
  FROM imports WHERE NOT coalesce(is_external, false)
  UNION ALL
  SELECT id, created_at, 'target_package_id', 'packages', CAST(target_package_id AS VARCHAR), coalesce(lower(trim(resolution_type)) = 'package', false)
  FROM imports WHERE NOT coalesce(is_external, false)),
parents AS (
  SELECT 'files' AS parent_table, file_path AS key, min(created_at) AS parent_at FROM files WHERE file_path IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'packages', CAST(id AS VARCHAR), min(created_at) FROM packages WHERE id IS NOT NULL GROUP BY ALL),
gone AS (SELECT DISTINCT CASE change WHEN 'deleted' THEN path WHEN 'renamed' THEN old_path END AS key FROM file_delta),
states AS (
  SELECT DISTINCT r.id AS import_id, r.ref_field, r.parent_table, r.key, r.created_at AS child_at,
    CASE WHEN r.key IS NULL THEN CASE WHEN r.demanded THEN 'unset' END
         WHEN p.key IS NULL THEN CASE WHEN r.parent_table = 'files' AND g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END
         WHEN p.parent_at > r.created_at THEN 'late' END AS state
  FROM refs r LEFT JOIN parents p ON p.parent_table = r.parent_table AND p.key = r.key LEFT JOIN gone g ON g.key = r.key)
"""

QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month}
SQL = {
    "p1_found": _P1 + "SELECT import_id, ref_field, state FROM states WHERE state IS NOT NULL",
    "p1_by_month": _P1 + "SELECT parent_table, ref_field, state, strftime(child_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_references, count(DISTINCT key) AS n_keys FROM states WHERE state IS NOT NULL GROUP BY ALL",
}
