"""User-level plans composed of operators."""
