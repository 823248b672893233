"""bitloom: a Spark-native store and exact search engine for text chunks with binary codes."""
