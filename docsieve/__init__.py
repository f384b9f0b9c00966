"""docsieve: document search and facet analytics as plain Spark DataFrames."""
