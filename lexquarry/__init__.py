"""lexquarry: evidence-grounded document analytics as Spark DataFrame programs."""

__version__ = "0.1.0"
