"""The registered queries, each with the SQL that must give the same rows where there is one."""

from __future__ import annotations

from . import admission, jobs, net, packages, parts, process, scrub, streams  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
