"""docloom: a Spark-first engine for document extraction, review and evaluation."""
