"""siftwire: a Spark-first engine that turns overlapping text feeds into a small, deduplicated digest."""

__version__ = "0.1.0"
