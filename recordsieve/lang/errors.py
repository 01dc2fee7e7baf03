"""Errors of the language and of record processing."""


class SieveError(ValueError):
    """Base of all errors that a caller can cause."""


class ExpressionError(SieveError):
    """A selector, projection or mutation that does not parse."""


class UnsupportedPath(SieveError):
    """A path that parses but cannot be applied."""


class RecordError(SieveError):
    """Input that is not strict newline-delimited JSON, or a record that an action cannot take."""
