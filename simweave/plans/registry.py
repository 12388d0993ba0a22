"""Registry of the library's queries and of the SQL that each must agree with."""

from __future__ import annotations

from simweave.plans import queries as q
from simweave.plans import store_queries  # noqa: F401  registers its queries

FLAGSHIP = "cosine_pairs_by_type"


def queries() -> dict[str, q.Query]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLES)
