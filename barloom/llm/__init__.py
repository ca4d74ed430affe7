"""Operators for training data: documents, conversations, pages and embeddings."""
