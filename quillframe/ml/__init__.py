"""Models: generalized linear models, k-means, random forests."""
