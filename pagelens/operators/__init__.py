"""DataFrame operators: parsing, features, similarity joins, scaling, summaries."""
