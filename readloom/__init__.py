"""Read analytics and corpus preparation on Spark."""
