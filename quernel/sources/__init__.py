"""Sources and sinks: note folders, the snapshot store, rendered results."""
