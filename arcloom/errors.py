"""Errors of parsing, lowering, types and ingest."""


class GraphError(Exception):
    """Base of all errors raised by the engine itself."""


class QueryError(GraphError):
    """A query document that is malformed: identifiers, field references, depths, limits, empty returns."""


class LoweringError(GraphError):
    """A well-formed document that cannot be planned: unknown aliases, bad literals, missing group keys."""


class FieldTypeError(GraphError):
    """An unknown type, an operator it lacks, or a value it rejects."""


class IngestError(GraphError):
    """A graph document that cannot be stored."""


class Unsupported(GraphError):
    """An operation that this backend does not have."""
