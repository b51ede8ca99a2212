"""Analytics over database query activity as DataFrame and Structured Streaming operators."""
