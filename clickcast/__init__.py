"""clickcast: e-commerce clickstream analytics expressed as Spark DataFrame / SQL /
Structured Streaming / MLlib jobs."""

__version__ = "0.1.0"
