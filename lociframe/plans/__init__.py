"""Multi-step queries composed from operators."""
