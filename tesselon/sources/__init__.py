"""Readers and writers: layer files, canonical mapping, manifests, inventories."""
