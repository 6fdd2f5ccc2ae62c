"""Table-to-table Spark jobs for studying code-authorship signals in software history."""
