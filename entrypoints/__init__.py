"""The library's operators and reports as named queries over a folder of retail tables."""
