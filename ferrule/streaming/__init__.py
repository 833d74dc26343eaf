"""Message logs."""
