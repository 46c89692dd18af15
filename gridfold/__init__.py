"""gridfold: Spark-native analytics over ordered streams of two-dimensional grids."""

__version__ = "0.1.0"
