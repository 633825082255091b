"""Imaging-cohort data engine on PySpark: index, harmonize, curate, package, evaluate."""
