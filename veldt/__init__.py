"""veldt: spatio-temporal analytics as declarative Spark plans."""
