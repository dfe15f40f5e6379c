"""Readers of images, manifests, samples, ledgers and evaluation files."""
