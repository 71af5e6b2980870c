"""Rows through Structured Streaming. An extension: the rewrites themselves are batch."""

from .passthrough import through_stream

__all__ = ["through_stream"]
