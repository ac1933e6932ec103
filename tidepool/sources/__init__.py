"""Sources and sinks of bars."""
