"""threadloom: a Spark-native conversation inbox and digest engine.

Every operator is a function from DataFrames to a DataFrame. Nothing is
collected to the driver; time-dependent operators take an explicit ``as_of``.
"""

__version__ = "0.1.0"
