"""SQL lineage and relational operators on PySpark."""
