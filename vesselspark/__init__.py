"""PySpark jobs for maritime surveillance data: decode, correlate, fuse, analyse and search."""
