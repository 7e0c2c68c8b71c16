"""quern: an analytics engine written for Spark's DataFrame and SQL APIs."""

__version__ = "0.1.0"
