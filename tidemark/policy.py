"""A usage policy: thresholds beyond which a key is needed."""

from __future__ import annotations

from tidemark.errors import ComplianceError

USERS, REVENUE = 50_000, 10_000.0


def assert_compliance(users: int, revenue: float, has_key: bool = False, max_users: int = USERS, max_revenue: float = REVENUE) -> None:
    if (users > max_users or revenue > max_revenue) and not has_key:
        raise ComplianceError(f"{users} monthly users and {revenue} revenue need a key")
