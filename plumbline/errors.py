"""Errors of specifications."""


class SpecError(ValueError):
    """A specification that is not well formed."""


class UnknownFunction(SpecError):
    """A function id that is not registered."""


class MissingColumns(SpecError):
    """Columns that an expression names and the relation lacks."""


class UnsupportedFormat(ValueError):
    """A file format without a reader or writer."""
