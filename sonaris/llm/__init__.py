"""Training-data operators: everything here is optional to the rest of the library."""
