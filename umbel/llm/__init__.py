"""Training-data operators. Nothing else in umbel imports this subpackage."""
