"""The same operators over micro-batches."""
