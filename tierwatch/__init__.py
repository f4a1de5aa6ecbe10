"""tierwatch: supplier-risk analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames; nothing in a
transformation collects rows to the driver.
"""

__version__ = "0.1.0"
