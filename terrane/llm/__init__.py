"""Training-data operators over document, page and conversation tables."""
