"""veilgrid: observe, compare and safely share tables and documents with Spark."""

__version__ = "0.1.0"
