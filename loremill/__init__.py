"""Knowledge analytics on Spark: notes, links, sessions, tasks and search as DataFrames."""
