"""Article ingestion and text analytics on PySpark."""
