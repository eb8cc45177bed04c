"""Errors, by kind."""

from __future__ import annotations


class ValidationError(ValueError):
    """A name, IRI, tag, value or clause that is not well formed."""


class QueryError(Exception):
    """A query or update that failed.

    kind: parse, analysis, timeout, abort, execution, protocol (a result of another shape), unknown.
    """

    def __init__(self, kind: str, message: str, query: object = None, cause: BaseException | None = None):
        super().__init__(message)
        self.kind, self.query, self.cause = kind, query, cause


def is_timeout_error(e: object) -> bool:
    return isinstance(e, QueryError) and e.kind == "timeout"


def is_abort_error(e: object) -> bool:
    return isinstance(e, QueryError) and e.kind == "abort"
