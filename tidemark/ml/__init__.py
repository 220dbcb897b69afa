"""Training sets, boosted-tree models, search and batch scoring on MLlib."""
