"""Reading and writing the store, the landing area and exports."""
