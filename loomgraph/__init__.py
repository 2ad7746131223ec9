"""Analytics over semantic graphs: symbols, ordered chains, call records and vectors as Spark tables."""
