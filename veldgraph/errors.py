"""Exceptions of query planning, rules and history."""


class VeldgraphError(Exception):
    pass


class ParseError(VeldgraphError):
    """The text is not a valid query, Turtle document or schema."""


class Unscoped(VeldgraphError):
    """A pattern can't be tied to a class of the catalog."""


class UpdateRejected(VeldgraphError):
    """The text is an update; only queries run."""


class UnsupportedConstruct(VeldgraphError):
    """Valid syntax that the engine does not run."""


class ResultLimitExceeded(VeldgraphError):
    """A result has more rows than the caller allows."""


class TripleLimitExceeded(VeldgraphError):
    """A graph has more triples than the caller allows."""
