"""Readers, generators and writers of body tables."""
