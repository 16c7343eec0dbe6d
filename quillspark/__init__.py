"""Analytics of long-form text corpora, and of the product data around them, on Spark."""
