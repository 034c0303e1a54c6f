"""cartolith: geospatial tile, feature, event-feed and signal-log analytics on PySpark.

Every public function takes Columns or DataFrames and returns Columns or DataFrames;
nothing here executes a job unless its docstring says so.
"""
