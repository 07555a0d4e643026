"""Code-graph and call-trace analytics as Spark DataFrame operators."""
