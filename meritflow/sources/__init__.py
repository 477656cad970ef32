"""Sources and sinks (SRC1-SRC10)."""
