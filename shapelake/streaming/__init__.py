"""Running results over arriving specimens."""
