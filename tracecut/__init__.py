"""tracecut: dependence slicing over ordered operation logs, and the relational work around it, as Spark plans."""
