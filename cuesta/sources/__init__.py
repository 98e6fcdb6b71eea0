"""Readers and writers: item catalogues, trace files, gridded rasters, tables of results."""
