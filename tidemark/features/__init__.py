"""Feature computation in batch, and the feature store over its results."""
