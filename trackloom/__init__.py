"""trackloom: moving-object analytics as declarative Spark plans."""
