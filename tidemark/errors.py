"""Errors that callers can tell apart."""


class TidemarkError(Exception):
    """Any error of this engine."""


class IoError(TidemarkError):
    """Storage could not be read or written."""


class SignatureMismatchError(TidemarkError):
    """A file doesn't begin like an artifact."""


class CorruptionError(TidemarkError):
    """A checksum, offset or length of stored data is wrong."""


class UnsupportedVersionError(CorruptionError):
    """A manifest or artifact of a later version."""


class WasmError(TidemarkError):
    """A byte function could not be loaded or trapped."""


class ReadOnlyError(TidemarkError):
    """A mutation of a published or streamed database."""


class TableNotFoundError(TidemarkError):
    def __init__(self, name: str):
        super().__init__(f"no such table: {name}")
        self.name = name


class SchemaError(TidemarkError):
    """Unknown column, wrong number of values, a value of the wrong kind."""


class QueryError(TidemarkError):
    """A statement that can't be read or means nothing."""


class ManifestError(TidemarkError):
    """A catalog that can't be read."""


class ComplianceError(TidemarkError):
    """A usage policy is violated."""
