"""Facts of Python sources: one pass over syntax trees on the executors, everything after it is relational."""
