"""Errors of the query language and the select API."""


class QueryError(Exception):
    """Base of all."""


class ParseError(QueryError):
    pass


class UnknownFunction(QueryError):
    pass


class ArgumentCount(QueryError):
    pass


class TypeMismatch(QueryError):
    pass


class EvalError(QueryError):
    pass


class RegexError(QueryError):
    pass


class InvalidRequest(QueryError):
    pass


class UnsupportedAggregation(QueryError):
    pass
