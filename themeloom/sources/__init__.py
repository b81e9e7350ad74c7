"""Readers and writers for documents, labelled text and token labels."""
