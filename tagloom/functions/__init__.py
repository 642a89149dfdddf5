"""Column -> Column helpers. Everything here is a built-in Spark expression except Jaro-Winkler
(an Arrow-batched pandas UDF meant for distinct token pairs only)."""
