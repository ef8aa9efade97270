"""Column to Column functions; none triggers a job, all stay in generated code."""
