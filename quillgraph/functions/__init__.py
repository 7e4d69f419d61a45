"""Part of quillgraph: see the module docstrings."""
