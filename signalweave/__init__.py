"""Item feeds, event grouping, convergence analytics and digests as Spark jobs."""
