"""What is read and written: events, messages, policies, reports."""
