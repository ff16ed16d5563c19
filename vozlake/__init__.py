"""Vozlake: Spark operators for curating, splitting and scoring speech corpora.

Every operator is a function from DataFrame to DataFrame.  Nothing here keeps a
global session, decodes audio or runs a model: words, frames, embeddings and
probabilities arrive as tables.
"""

__version__ = "0.1.0"
