"""Change-stream analytics and large-corpus preparation on PySpark."""
