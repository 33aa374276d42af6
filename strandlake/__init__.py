"""strandlake: sequencing analytics expressed as Spark DataFrame transformations."""
