"""terrace: relational code-and-document intelligence on PySpark."""
