"""Tables to start from, and readers and writers of geometry."""
