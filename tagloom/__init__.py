"""tagloom: Spark-native analytics for tagged file collections and their tag wiki.

Layout
------
sources/    readers for the driver tables, derived input views, file folders, label vocabularies
functions/  Column -> Column helpers (text normalisation, Jaro-Winkler, formatting)
operators/  DataFrame -> DataFrame operators (tag rules, statistics, dataset state, caption merge, markup)
plans/      composed jobs (dataset tagging, wiki build + search) and the query registry / SQL oracles
streaming/  Structured Streaming variants of the incremental jobs
"""

__version__ = "0.1.0"
