"""Spark-first analytics over layout specifications, render reports, assets and pixels."""
