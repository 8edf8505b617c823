"""corpusmill: DataFrame operators for text and knowledge corpora on PySpark."""
