"""Format connectors: raw strings to documents and back, by Arrow batches; see ``registry``."""

from .registry import Format, convert, get_format, has_format, lens_from_hub, lens_to_hub, list_formats, read_format, register_format, round_trip, write_format

__all__ = ["Format", "convert", "get_format", "has_format", "lens_from_hub", "lens_to_hub", "list_formats", "read_format", "register_format", "round_trip", "write_format"]
