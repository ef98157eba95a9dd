"""Operations a training-data pipeline needs, over a table of documents (doc_id, text, ...)."""
