"""Cost analytics over system tables.  Everything takes and returns DataFrames and an explicit as_of."""
