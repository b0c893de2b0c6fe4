"""Readers, writers and the boundary to OCR and models."""
