"""Reading-library analytics expressed with the DataFrame API."""
