"""The queries of the engine and the SQL that each is held against."""
