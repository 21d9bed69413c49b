"""The query catalogue over the driver's tables, with one SQL statement per query where SQL can say it."""
