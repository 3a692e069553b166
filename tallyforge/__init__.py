"""tallyforge: source-code analytics as PySpark DataFrame queries."""

__version__ = "0.1.0"
