"""Event-synchrony and signal-feature analytics expressed as Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns). Nothing here keeps a session, collects rows or depends on one
machine's disk.
"""
