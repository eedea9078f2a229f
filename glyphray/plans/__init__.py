"""End-to-end flows assembled from the operators."""
