"""Functions of the engine; see the module docstrings."""
