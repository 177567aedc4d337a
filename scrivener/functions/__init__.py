"""Column functions and the character classes they use."""
