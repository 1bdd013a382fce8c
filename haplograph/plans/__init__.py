"""Assembly as compositions of the operators."""
