"""Functions: Column in, Column out."""
