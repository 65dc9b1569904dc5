"""Byte-corpus analytics and retrieval on Spark.

``grainmill.llm`` holds the training-data operators; nothing outside it imports it.
"""

__version__ = "0.1.0"
