"""Errors of the engine."""


class GraphError(Exception):
    """Base of all errors raised here."""


class UnsupportedError(GraphError):
    """A statement or probe that the engine does not accept."""


class UnknownNameError(GraphError):
    """A name that the catalog does not have."""


class DuplicateNameError(GraphError):
    """A name that is already taken."""


class SchemaConflictError(GraphError):
    """A declared name exists with another shape."""


class PropertyTypeError(GraphError):
    """A value or subject does not fit its property key."""


class UnknownElementError(GraphError):
    """An element, relation or incidence that is not visible."""


class InvalidProjectionError(GraphError):
    """A projection that the data or the request do not fit."""


class CycleError(GraphError):
    """An order was asked for that a cycle rules out."""


class PageRankError(GraphError):
    """A PageRank configuration, weight or teleport vector is unusable."""


class NonConvergedError(PageRankError):
    """The tolerance was not reached within the iterations allowed."""


class SyncError(GraphError):
    """A change log that cannot be applied."""


class RegistrationError(GraphError):
    """A relational registration that is not valid."""


class CommitConflictError(GraphError):
    """Another writer published the version first."""
