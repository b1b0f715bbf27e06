"""fretwork: retail analytics and advisor data jobs written for Spark."""

__version__ = "0.1.0"
