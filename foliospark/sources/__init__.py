"""Sources and sinks: recorded fetches, live fetches, CSV, extraction state."""
