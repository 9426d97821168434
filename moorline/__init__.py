"""moorline: a Spark-first engine for rule-conditioned comment tables."""

__version__ = "0.1.0"
