"""firegrid: gridded fire and weather analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
