"""skein: analytics over code-and-knowledge graphs, documents and event logs, on Spark."""
