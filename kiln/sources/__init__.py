"""Sources and sinks: CSV scan/sink, prediction sink, previews and profiles."""
