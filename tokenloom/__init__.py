"""Source-code corpus preparation as Spark jobs: clean, learn a vocabulary, encode, pack."""
