"""Query plans composed of the operators."""
