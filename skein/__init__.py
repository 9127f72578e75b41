"""skein: a Spark-native analytics engine for conversations, documents and the knowledge graph between them."""

__version__ = "0.1.0"
