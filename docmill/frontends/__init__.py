"""Text front ends: a small query language and method names."""
