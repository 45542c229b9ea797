"""Training-data operators: thirteen dealt operators and their digest queries."""
