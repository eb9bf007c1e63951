"""Where documents come from and where the index tables live."""
