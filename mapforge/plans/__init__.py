"""The engine's queries on the driver's tables, each with SQL that another engine runs for comparison."""
