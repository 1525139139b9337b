"""Training-data operators over texts, vectors and conversations.  Nothing outside imports this."""
