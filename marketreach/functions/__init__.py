"""Column expressions: no function here starts a job or registers a UDF."""
