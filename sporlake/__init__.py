"""Evidence-record analytics on Spark: DataFrame operators for keyed company claims, snapshots and texts."""

__version__ = "0.1.0"
