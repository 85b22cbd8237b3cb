"""File formats: readers and writers as Python data sources and DataFrame functions."""
