"""Analytics over fund proxy-voting records, written as Spark DataFrame operators."""
