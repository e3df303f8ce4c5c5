"""What can go wrong, by kind."""

from __future__ import annotations


class QueryError(Exception):
    code = "P0000"


class InvalidQuery(QueryError, ValueError):
    """The query can't be built."""


class NotFound(QueryError, LookupError):
    """An ...or_raise action found no row."""

    code = "P2025"


class TimedOut(QueryError, TimeoutError):
    code = "P1008"


class UniqueViolation(QueryError):
    code = "P2002"


class ForeignKeyViolation(QueryError):
    code = "P2003"


class TransactionConflict(QueryError):
    """Another writer published a version first."""

    code = "P2034"


def classify(error: BaseException) -> str:
    """A stable code for any error."""
    if isinstance(error, QueryError):
        return error.code
    text = str(error).lower()
    for code, words in (("P1001", ("connection refused", "unreachable")), ("P1008", ("timed out", "timeout")), ("P1017", ("connection closed", "connection reset"))):
        if any(w in text for w in words):
            return code
    return "P0000"
