"""Errors raised for wrong arguments, before any Spark job starts."""


class ToolkitError(ValueError):
    """An argument does not fit the data or the operator."""


class UnknownColumnError(ToolkitError):
    """A named column is not in the DataFrame."""


class UnknownDatasetError(ToolkitError):
    """A named dataset does not exist."""


class ReadOnlyError(ToolkitError):
    """A SQL text is not a single read-only statement."""


class ConflictError(ToolkitError):
    """A dataset was replaced by another writer in the meantime."""
