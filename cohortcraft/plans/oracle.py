"""All oracle SQL (DuckDB dialect), keyed like the query registry."""

from .oracle_loans import SQL as _LOANS
from .oracle_retention import SQL as _RETENTION


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(_RETENTION)
    out.update(_LOANS)
    return out
