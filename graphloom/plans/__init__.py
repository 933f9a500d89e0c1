"""Query plans: expressions, logical operators, and the two front ends."""
