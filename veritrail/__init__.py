"""Document structuring, hybrid retrieval, rubric ranking and audit as Spark DataFrame operators."""
