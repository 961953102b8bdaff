"""Session analytics on Spark: profile, clean, relate, measure and monitor raw tables."""

__version__ = "0.1.0"
