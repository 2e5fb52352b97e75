"""Property-listing analytics and price estimation as Spark DataFrame transformations."""
