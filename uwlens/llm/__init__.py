"""Training-data operators: corpus operators, each usable on its own, and their queries."""
