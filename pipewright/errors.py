"""Errors that users see."""


class QueryError(Exception):
    """A query that cannot be parsed, bound or run."""


class ParseError(QueryError):
    pass


class PlanError(QueryError):
    pass


class LoadError(QueryError):
    pass


class WriteError(QueryError):
    pass
