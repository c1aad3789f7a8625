"""Column functions: text normalisation, tokens, syllable shape, edit distances, number words."""
