"""bytestrata: binary content as relational data, on PySpark."""
