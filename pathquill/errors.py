"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors; ``code`` names the kind for callers over a wire."""

    code = "ERROR"


class QueryParseError(EngineError):
    code = "QUERY_PARSE"


class OptionRepeatedError(QueryParseError):
    """skip or limit given twice."""

    code = "OPTION_REPEATED"


class UnsetPlaceholderError(EngineError):
    code = "UNSET_PLACEHOLDER"


class InvalidPlaceholderError(EngineError):
    """No such placeholder, or a value of a kind that its place does not take."""

    code = "INVALID_PLACEHOLDER"


class PatchError(EngineError):
    code = "PATCH"


class PatchTestError(PatchError):
    code = "PATCH_TEST"


class NotFoundError(EngineError):
    code = "NOT_FOUND"


class CollectionNotFoundError(NotFoundError):
    code = "COLLECTION_NOT_FOUND"


class CollectionExistsError(EngineError):
    code = "COLLECTION_EXISTS"


class UniqueViolationError(EngineError):
    code = "UNIQUE_VIOLATION"


class IndexMismatchError(EngineError):
    code = "INDEX_MISMATCH"


class NoPrimaryKeyError(EngineError):
    code = "NO_PRIMARY_KEY"


class ReadOnlyError(EngineError):
    code = "READ_ONLY"


class InvalidNameError(EngineError):
    code = "INVALID_NAME"
