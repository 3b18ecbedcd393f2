"""millrace: posting analytics and corpus preparation as PySpark DataFrame jobs."""
