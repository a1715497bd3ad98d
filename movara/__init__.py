"""Business-table analytics expressed as Spark DataFrame plans."""
