"""Readers and writers of notes, logs and corpora."""
