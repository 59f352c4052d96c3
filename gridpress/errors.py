"""Failures a caller can branch on by ``code``."""

from __future__ import annotations


class GridpressError(Exception):
    code = "ERROR"

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.details = details


class FilterNotAllowed(GridpressError):
    code = "FILTER_NOT_ALLOWED"


class SortNotAllowed(GridpressError):
    code = "SORT_NOT_ALLOWED"


class InvalidPagination(GridpressError):
    code = "INVALID_PAGINATION"


class ValueCastError(GridpressError):
    code = "VALUE_CAST_ERROR"


class SchemaMismatch(GridpressError):
    code = "SCHEMA_MISMATCH"


class UnprocessableContent(GridpressError):
    code = "UNPROCESSABLE_CONTENT"


class UnsupportedMediaType(GridpressError):
    code = "UNSUPPORTED_MEDIA_TYPE"


class RowsLimitExceeded(GridpressError):
    code = "ROWS_LIMIT_EXCEEDED"


class PayloadTooLarge(GridpressError):
    code = "PAYLOAD_TOO_LARGE"


class SourceConfigInvalid(GridpressError):
    code = "SOURCE_CONFIG_INVALID"


class VersionConflict(GridpressError):
    code = "VERSION_CONFLICT"


class InvalidState(GridpressError):
    code = "DATASET_INVALID_STATE"


class NotFound(GridpressError):
    code = "NOT_FOUND"


class DatasetUnresolved(GridpressError):
    code = "DATASET_UNRESOLVED"


class DatasetNotPublished(GridpressError):
    code = "DATASET_NOT_PUBLISHED"
