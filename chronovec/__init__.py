"""Analytics over time-ordered embedding series, as Spark DataFrame operators."""
