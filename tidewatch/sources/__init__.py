"""Raw payloads in, normalised items out; the article store and the board sink."""
