"""Nothing here: no operator of this library keeps state over a stream."""
