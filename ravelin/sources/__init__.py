"""Files and tables as sources and sinks."""
