"""Feature values on two clocks, as PySpark DataFrames: when a value was true, and when it became known."""
