"""Analytics over spoken and written interview data, as Spark jobs."""
