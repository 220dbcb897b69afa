"""Feature engineering, point-in-time joins and monitoring as Spark DataFrame operators."""
