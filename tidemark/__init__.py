"""Analytics over timestamped observation logs, as composable Spark DataFrame operators."""
