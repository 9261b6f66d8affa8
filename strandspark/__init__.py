"""Secondary-structure statistics of nucleic acids as Spark jobs."""
