"""Multi-way joins and relational queries, planned on the driver and run as DataFrames."""
