"""Training-data operators (documents, embeddings, pages): one module per operator."""
