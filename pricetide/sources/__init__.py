"""Readers: landed JSON snapshots, manifests, normalised tables, holdings files."""
