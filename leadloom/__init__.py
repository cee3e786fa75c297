"""leadloom: lead-data analytics expressed as PySpark plans."""
