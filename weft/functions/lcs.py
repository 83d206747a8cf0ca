"""Longest common subsequence lengths for the metrics that need them (G09 ROUGE-L, F26)."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def lcs_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time.

    The row is one integer with a zero bit where the table's value grows, so an item of
    ``b`` costs a few operations on ``len(a)`` bits instead of a loop over ``a``.
    """
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_sql(source: str) -> str:
    """DuckDB CTEs ``lcs(id, n)`` for ``source``, a query of (id, x, y) with x and y lists."""
    cand = "list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN 0::BIGINT ELSE greatest(cells[j + 1], cells[j] + (y[j] = x[i + 1])::BIGINT) END)"
    return f"""pairs AS ({source}),
steps AS (SELECT id, x, y, 0::BIGINT AS i, list_transform(range(0, len(y) + 1), lambda j: 0::BIGINT) AS cells FROM pairs
  UNION ALL SELECT id, x, y, i + 1, list_transform(range(0, len(y) + 1), lambda j: list_max(cand[1:j + 1])) FROM
    (SELECT *, {cand} AS cand FROM steps WHERE i < len(x)) s),
lcs AS (SELECT id, len(x) AS nx, len(y) AS ny, list_max(cells) AS n FROM steps WHERE i = len(x))"""
