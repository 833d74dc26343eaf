"""Rule texts and graph texts, parsed on the driver."""
