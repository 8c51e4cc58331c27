"""A catalogue of source code, built and searched with Spark."""
