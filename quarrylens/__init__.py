"""Code and schema intelligence on Spark: graph, SQL-condition, index, migration and text operators."""
