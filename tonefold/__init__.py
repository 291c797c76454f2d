"""Signal-set analytics and corpus preparation on PySpark."""
