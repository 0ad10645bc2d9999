"""Configuration, the whole search, and the registered queries."""
