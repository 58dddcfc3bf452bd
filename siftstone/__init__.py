"""siftstone: a PySpark engine for mining, profiling and auditing source code at scale."""

__version__ = "0.1.0"
