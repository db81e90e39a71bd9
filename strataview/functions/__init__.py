"""The expression language: parsing, Spark columns, and row evaluation."""
