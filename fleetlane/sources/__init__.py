"""Readers: the driver's parquet tables and the fleet's own file formats."""
