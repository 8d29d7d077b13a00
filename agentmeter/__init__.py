"""Usage analytics for coding agents, written as DataFrame-to-DataFrame operators for PySpark."""
