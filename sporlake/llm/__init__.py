"""Text and matching operators for training corpora; nothing outside this package imports it."""
