"""corpusmill: corpus search, graph and rule analytics as DataFrame plans on Apache Spark."""
