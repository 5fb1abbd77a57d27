"""Errors raised before or during a read, a page, a statistic or an export."""


class TableProbeError(ValueError):
    """Base of every error a caller can cause with its input."""


class TableReadError(TableProbeError):
    """The input is missing, damaged, ragged or of an unsupported type."""


class ColumnNotFoundError(TableProbeError):
    """A statistic or a value count was asked for a column that is not there."""


class FilterError(TableProbeError):
    """A filter cannot be applied to the type of its column."""


class SheetLimitError(TableProbeError):
    """A table does not fit the grid of one spreadsheet."""


class ExportError(TableProbeError):
    """An export was asked for in a format that cannot hold it."""
