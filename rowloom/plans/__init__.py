"""Ready-made plans over the sample tables, and helpers to look at plans."""
