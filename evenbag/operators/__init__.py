"""Rewrites: functions DataFrame -> DataFrame that keep the bag of rows and the schema."""

from . import codecs, dml, expansions, joins, layouts, partitionings, projections, windows

__all__ = ["codecs", "dml", "expansions", "joins", "layouts", "partitionings", "projections", "windows"]
