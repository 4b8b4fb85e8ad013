"""Support-ticket analytics as Spark DataFrame transforms.

Every public function takes DataFrames (or columns) and returns DataFrames (or
columns).  Batch and Structured Streaming jobs share the same transforms.
"""
