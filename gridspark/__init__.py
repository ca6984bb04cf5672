"""gridspark: statistical downscaling of gridded climate data on Spark.

Grid tables are DataFrames keyed by ``time, y, x`` with one column per
variable. Every operator maps DataFrames to DataFrames and runs on Spark.
"""

__version__ = "0.1.0"
