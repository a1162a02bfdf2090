"""Named queries composed of operators."""
