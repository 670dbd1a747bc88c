"""Readers and writers: driver tables, file snapshots, diffs, reports."""
