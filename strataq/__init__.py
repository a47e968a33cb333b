"""Indexed columnar datasets on Spark: declared schemas, row groups with zone maps
and Bloom filters, validated scan plans, encodings and integrity checks."""
