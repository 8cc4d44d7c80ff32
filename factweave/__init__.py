"""factweave: a Spark-native engine for temporal, provenance-carrying concept graphs."""

__version__ = "0.1.0"
