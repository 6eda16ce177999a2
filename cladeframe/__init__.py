"""cladeframe: gene-family analytics as Spark DataFrame operators."""
