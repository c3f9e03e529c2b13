"""Plan building blocks shared by all operators."""
