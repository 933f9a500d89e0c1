"""Errors that queries and updates raise."""


class GraphError(Exception):
    """Base of all errors of this package."""


class QueryProcessingError(GraphError):
    """A query is malformed or asks for what its plan cannot give."""


class UnknownIndex(GraphError):
    """An index scan names a label and property without an index."""


class OrphanedRelationship(GraphError):
    """A node cannot go while relationships hang on it."""


class UdfNotFound(GraphError):
    """No function of that name is registered."""


class UnknownProperty(GraphError):
    """No label in question has that property."""


class UnknownId(GraphError):
    """No node or relationship has that id."""
