"""SQL that the Spark queries are checked against, written apart from them."""
