"""Change-review analytics and corpus preparation as Spark DataFrame transforms."""
