"""A filter-language analytics engine that compiles to Spark DataFrame plans."""
