"""Tables and adapters."""
