"""Trust-flow analytics over code inventories, expressed as Spark plans."""
