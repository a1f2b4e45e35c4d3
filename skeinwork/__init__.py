"""Session-level analysis of online conversations, expressed as Spark DataFrame functions."""
