"""Group movement analysis over GPS tracks as Spark DataFrame jobs."""
