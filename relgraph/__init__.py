"""Mining descriptive relation graphs from text, as DataFrame plans."""
