"""Entity, time-series and vector analytics as DataFrame and Spark SQL plans."""

__version__ = "0.1.0"
