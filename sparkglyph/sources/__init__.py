"""Where texts, lists and models come from, and where counts and models are kept."""
