"""Column functions: type names, text views, wire forms and numbers written as text."""

from .numbers import numeric_view, text_number_kind, text_to_double, text_to_long
from .text import (
    EMPTY_TOKEN,
    NULL_TOKEN,
    blob_placeholder,
    blob_size_text,
    display_value,
    double_text,
    file_size_text,
    hex_text,
    slugify,
    text_or_token,
    text_view,
    truncate_text,
)
from .types import column, null_columns_to_string, simplify_type
from .wire import finite, row_json, wire_view

__all__ = [
    "EMPTY_TOKEN",
    "NULL_TOKEN",
    "blob_placeholder",
    "blob_size_text",
    "column",
    "display_value",
    "double_text",
    "file_size_text",
    "finite",
    "hex_text",
    "null_columns_to_string",
    "numeric_view",
    "row_json",
    "simplify_type",
    "slugify",
    "text_number_kind",
    "text_or_token",
    "text_to_double",
    "text_to_long",
    "text_view",
    "truncate_text",
    "wire_view",
]
