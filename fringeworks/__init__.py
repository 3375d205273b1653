"""Analytics over large collections of sampled phase traces, on Spark."""
