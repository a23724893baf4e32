"""Analytics over timed media as DataFrames: frames, speech, descriptions, vectors, graphs and retrieval."""
