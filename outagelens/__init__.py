"""outagelens: outage and ticket analytics as Spark DataFrame / SQL / MLlib jobs."""

__version__ = "0.1.0"
