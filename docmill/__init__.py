"""A document-query and analytics engine on PySpark."""
