"""Table schemas, readers and writers, and the shared folder for intermediate tables."""
