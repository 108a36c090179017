"""Steps of the linkage, from records to clusters and metrics."""
