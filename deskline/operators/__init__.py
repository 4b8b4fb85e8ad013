"""DataFrame transforms over tickets, feedback, vectors and the memo."""
