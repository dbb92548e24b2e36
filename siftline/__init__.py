"""siftline: search and data preparation over text corpora, expressed as Spark DataFrame plans."""
