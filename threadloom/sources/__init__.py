"""Readers and writers of message archives."""
