"""Training-data operators: tokens, secrets, mixing, shards, licences, repeats, vectors, quality, near copies."""
