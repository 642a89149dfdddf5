"""Sources: driver tables, derived input views, file folders, label vocabularies."""
