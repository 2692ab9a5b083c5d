"""tradelens: disclosed-trade analytics expressed as Spark DataFrame and SQL plans."""
