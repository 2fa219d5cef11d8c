"""Column functions, all built from Spark expressions unless a docstring says otherwise."""
