"""Listings, file bytes and written tables."""
