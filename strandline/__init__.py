"""Point-in-time equity analytics as Spark DataFrame transformations."""
