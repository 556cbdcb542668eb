"""A Spark library that turns tables of files and web pages into Markdown corpora."""
