"""Log analytics as PySpark DataFrame operators over a ``logs`` table or stream."""

__version__ = "0.1.0"
