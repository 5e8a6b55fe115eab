"""Tables and files: reading, writing, caching."""
