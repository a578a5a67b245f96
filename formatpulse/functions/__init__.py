"""Column functions: curves, rates, text, vectors, arrays. No function here shuffles."""
