"""Archives and compressed streams as Spark tables."""
