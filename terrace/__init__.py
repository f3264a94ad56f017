"""Layered-warehouse analytics on PySpark: ETL, data quality, lineage and schema evolution."""
