"""Raster-as-table analytics on PySpark: composites, local tree ensembles, zonal and accuracy reports."""
