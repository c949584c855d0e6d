"""Quirewise: a Spark-first engine for reviewing digitised documents."""
