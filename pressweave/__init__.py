"""Story analytics for multi-source news, written as PySpark DataFrame jobs."""
