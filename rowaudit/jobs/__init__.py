"""The registered queries, with their SQL for the other engine."""

from . import count_audit, data_audit, object_audit, run_audit, type_audit
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "count_audit", "data_audit", "object_audit", "run_audit", "type_audit"]
