"""Registration of queries together with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return keep


def leaders_sql(p: str = "") -> str:
    """Greedy selection over CTEs ``{p}o(node, ...)`` and ``{p}e(a, b, rb)`` (b comes before a): ``{p}s(node, lead)``.
    Every round decides the nodes whose earlier neighbours are decided; needs WITH RECURSIVE."""
    return f"""{p}r AS (SELECT 0 AS round, node, CAST(NULL AS BOOLEAN) AS lead FROM {p}o
  UNION ALL
  SELECT round + 1, node, CASE WHEN lead IS NOT NULL THEN lead WHEN taken THEN false WHEN wait THEN NULL ELSE true END
  FROM (SELECT max(x.round) AS round, x.node, bool_or(x.lead) AS lead, coalesce(bool_or(n.lead), false) AS taken, coalesce(bool_or(e.b IS NOT NULL AND n.lead IS NULL), false) AS wait
        FROM {p}r x LEFT JOIN {p}e e ON e.a = x.node LEFT JOIN {p}r n ON n.node = e.b GROUP BY x.node) y
  WHERE EXISTS (SELECT 1 FROM {p}r WHERE lead IS NULL)),
{p}s AS MATERIALIZED (SELECT node, bool_or(lead) AS lead FROM {p}r WHERE lead IS NOT NULL GROUP BY 1)"""


def one_to_one_sql(pairs: str, order: str, p: str = "") -> str:
    """Pairs (image, prediction, truth, ...) of a CTE chosen greedily in an order, each side once: CTE ``{p}m``."""
    return f"""{p}o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS node FROM {pairs}),
{p}e AS MATERIALIZED (SELECT a.node AS a, b.node AS b, b.node AS rb FROM {p}o a JOIN {p}o b ON a.image = b.image AND a.prediction = b.prediction AND b.node < a.node
  UNION SELECT a.node, b.node, b.node FROM {p}o a JOIN {p}o b ON a.image = b.image AND a.truth = b.truth AND b.node < a.node),
{leaders_sql(p)}, {p}m AS MATERIALIZED (SELECT {p}o.* FROM {p}o JOIN {p}s USING (node) WHERE lead)"""
